"""Deterministic inputs derived by Spark from the driver tables.

The reference consumes (path, label, hypothesis) pairs produced by a speech
recogniser.  These builders derive the same shapes from ``documents`` and the
other tables with keyed draws (``lexiflow.functions.rng``), so the derivation
scales with the tables and does not depend on partitioning.  Whole texts are
used throughout.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.functions import rng
from lexiflow.functions.text import words
from lexiflow.session import text_batches
from lexiflow.sources.tables import table

SEED = 42
# ---- fixed fixture parameters ------------------------------------------------
TYPO_RATE = 0.10        # share of words of length >= 4 that lose one character
TYPO_MIN_LEN = 4
FAIL_NULL_RATE = 0.02   # hypothesis missing (failed recognition)
FAIL_BLANK_RATE = 0.02  # hypothesis blank ('  ')
BEAM_SUB_RATE = 0.06    # second system: words replaced by 'zzz'
BEAM_OMIT_RATE = 0.15   # second system: rows missing, so the join drops them
BEAM_DUP_RATE = 0.05    # second system: rows present twice, so the join multiplies them
TURN_DROP, TURN_DOUBLE, TURN_SWAP, TURN_ADD = 0.05, 0.10, 0.15, 0.18  # upper ends of the draws that change a word of a turn
TURN_FILLER = "uh"
ID_OFFSET = 7           # ids start after the 7 special tokens
ID_RANGE = 1000
# ------------------------------------------------------------------------------


def _rows_of_words(row_id: pa.Array, text: pa.Array):
    """(row id, words) of an Arrow batch, NULL texts as None, and the digits of every place in its longest row."""
    split = [None if t is None else t.split() for t in text.to_pylist()]
    longest = max((len(w) for w in split if w is not None), default=0)
    return list(zip(row_id.to_pylist(), split)), [b"%d" % i for i in range(longest)]


def _typos(row_id, text, seed):
    """The words of ``text``; those whose keyed draw hits lose one keyed character."""
    bound = rng.plain_bound(TYPO_RATE)

    @F.arrow_udf(T.StringType())
    def typos(row_id: pa.Array, text: pa.Array) -> pa.Array:
        rows, digits = _rows_of_words(row_id, text)
        for row, ws in rows:
            hit, at = rng.key_head(seed, "typo", row), rng.key_head(seed, "typo_at", row)
            for i, w in enumerate(ws or ()):
                if len(w) >= TYPO_MIN_LEN and rng.md5(hit + digits[i]).digest() < bound:
                    cut = int(rng.plain_uniform(at + digits[i]) * len(w))
                    ws[i] = w[:cut] + w[cut + 1:]
        return pa.array([None if ws is None else " ".join(ws) for _, ws in rows], pa.string())
    return typos(row_id.cast("string"), text)


def _replaced(row_id, text, seed):
    """The words of ``text``; those whose keyed draw hits become 'zzz'."""
    bound = rng.plain_bound(BEAM_SUB_RATE)

    @F.arrow_udf(T.StringType())
    def replaced(row_id: pa.Array, text: pa.Array) -> pa.Array:
        rows, digits = _rows_of_words(row_id, text)
        for row, ws in rows:
            head = rng.key_head(seed, "beam", row)
            if ws is not None:
                ws[:] = ["zzz" if rng.md5(head + d).digest() < bound else w for w, d in zip(ws, digits)]
        return pa.array([None if ws is None else " ".join(ws) for _, ws in rows], pa.string())
    return replaced(row_id.cast("string"), text)


def fingerprint(spark: SparkSession, sf_dir: str, tables=("documents",)) -> str:
    """Digest of the tables' file paths, sizes and times, and of this package's functions.
    Only the listing is read."""
    import hashlib
    import inspect

    from lexiflow.functions import text

    seen = []
    for t in tables:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir.rstrip('/')}/{t}.parquet")
        seen += sorted((r["path"], r["length"], str(r["modificationTime"])) for r in files.select("path", "length", "modificationTime").collect())
    src = "".join(inspect.getsource(m) for m in (sys.modules[__name__], text, rng))
    return hashlib.sha1(f"{seen}|{src}".encode()).hexdigest()[:16]


def _stored(spark: SparkSession, sf_dir: str, name: str, build, tables=("documents",)) -> DataFrame:
    """A derived input, written once per checkpoint folder and then read like the table it
    stands in for.  Its path carries the fingerprint of what it derives from, so
    changed files or functions are derived anew."""
    from lexiflow.session import ensure_checkpoint_dir
    from lexiflow.sources.io import materialize

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexiflow-inputs/{fingerprint(spark, sf_dir, tables)}/{name}"
    return materialize(build(), path)


def pairs(spark: SparkSession, sf_dir: str, seed: int = SEED, stored: bool = True) -> DataFrame:
    """pairs(row_id, path, hyp, ref): ref = document text, hyp = ref with typos."""
    if stored:
        return _stored(spark, sf_dir, f"pairs-{seed}", lambda: pairs(spark, sf_dir, seed, stored=False))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    text_batches(spark)
    noisy = _typos(F.col("doc_id"), F.col("text"), seed)
    u = rng.uniform(seed, "fail", F.col("doc_id"))
    hyp = (F.when(u < F.lit(FAIL_NULL_RATE), F.lit(None).cast("string"))
           .when(u < F.lit(FAIL_NULL_RATE + FAIL_BLANK_RATE), F.lit("  "))
           .otherwise(noisy))
    return d.select(
        F.col("doc_id").cast("bigint").alias("row_id"),
        F.concat(F.lit("/root/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        hyp.alias("hyp"),
        F.col("text").alias("ref"),
    )


def pseudo(spark: SparkSession, sf_dir: str, seed: int = SEED, stored: bool = True) -> DataFrame:
    """Second system's output: pseudo(output_dir, audio_part_name, beam)."""
    if stored:
        return _stored(spark, sf_dir, f"pseudo-{seed}", lambda: pseudo(spark, sf_dir, seed, stored=False))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    text_batches(spark)
    beam = _replaced(F.col("doc_id"), F.col("text"), seed)
    base = (d.where(rng.uniform(seed, "omit", F.col("doc_id")) >= F.lit(BEAM_OMIT_RATE))
            .select(F.concat(F.lit("../root/"), F.col("source"), F.lit("/")).alias("output_dir"),
                    F.col("doc_id").cast("string").alias("audio_part_name"),
                    beam.alias("beam"),
                    F.col("doc_id")))
    dups = base.where(rng.uniform(seed, "dup", F.col("doc_id")) < F.lit(BEAM_DUP_RATE))
    return base.unionByName(dups).drop("doc_id")


def noisy_turns(spark: SparkSession, sf_dir: str, seed: int = SEED, stored: bool = True) -> DataFrame:
    """noisy_turns(conv_id, turn, hyp, ref): ref = words of a conversation turn, hyp = the same with words left out,
    a character doubled or replaced by 'e', and a filler added."""
    if stored:
        return _stored(spark, sf_dir, f"turns-{seed}", lambda: noisy_turns(spark, sf_dir, seed, stored=False), ("conversations",))
    key = [F.col("conv_id"), F.col("turn")]

    def heard(w, i):
        at = F.floor(rng.uniform(seed, "turn_at", *key, i) * F.char_length(w)).cast("int")
        u = rng.uniform(seed, "turn", *key, i)
        head, ch, tail = F.substring(w, 1, at), F.substring(w, at + 1, 1), F.substring(w, at + 2, 2147483647)
        return (F.when(u < F.lit(TURN_DROP), F.array().cast("array<string>"))
                .when(u < F.lit(TURN_DOUBLE), F.array(F.concat(head, ch, ch, tail)))
                .when(u < F.lit(TURN_SWAP), F.array(F.concat(head, F.lit("e"), tail)))
                .when(u < F.lit(TURN_ADD), F.array(w, F.lit(TURN_FILLER))).otherwise(F.array(w)))

    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(F.flatten(F.transform(words("text"), heard)), " ").alias("hyp"), F.col("text").alias("ref"))


def many_files(spark: SparkSession, sf_dir: str, fmt: str = "parquet") -> str:
    """Folder of up to 256 files (lang, source) dealt by the digest of doc_id, rows by doc_id; none of the columns is a key."""
    from lexiflow.session import ensure_checkpoint_dir
    from lexiflow.sources.io import exists

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexiflow-inputs/{fingerprint(spark, sf_dir)}/many-files-{fmt}"
    if not exists(spark, path):
        rows = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2).alias("bucket"))
        rows = rows.repartition(16, "bucket").sortWithinPartitions("bucket", "doc_id").drop("doc_id")
        rows.write.mode("overwrite").option("header", "true").partitionBy("bucket").format(fmt).save(path)
    return path


class _WordIds(dict):
    def __missing__(self, w):
        self[w] = out = ID_OFFSET + int.from_bytes(rng.md5(w.encode()).digest()[:4], "big") % ID_RANGE
        return out


def word_ids(c):
    """Deterministic id per word: 7 + (first 32 bits of md5(word)) mod 1000; a word is hashed once a batch."""
    def ids_of(text: pa.Array) -> pa.Array:
        known, flat, starts = _WordIds(), [], []
        for t in text.to_pylist():
            starts.append(None if t is None else len(flat))
            flat += [known[w] for w in (t or "").split()]
        return pa.ListArray.from_arrays(pa.array([*starts, len(flat)], pa.int32()), pa.array(flat, pa.int32()))
    return F.arrow_udf(ids_of, T.ArrayType(T.IntegerType()))(c)


def ids(spark: SparkSession, sf_dir: str, stored: bool = True) -> DataFrame:
    """ids(row_id, ids ARRAY<INT>): one id per word of the whole document."""
    if stored:
        return _stored(spark, sf_dir, "ids", lambda: ids(spark, sf_dir, stored=False))
    text_batches(spark)
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("bigint").alias("row_id"), word_ids("text").alias("ids"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus(text): documents, benchmark items and conversation turns appended."""
    parts = [table(spark, sf_dir, t).select("text") for t in ("documents", "benchmark", "conversations")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logits(vec_id, embedding ARRAY<FLOAT>, label): scores and target class."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def frames(spark: SparkSession, sf_dir: str, n_frames: int = 16) -> DataFrame:
    """frames(vec_id, frames ARRAY<ARRAY<FLOAT>>): the vector cut into equal frames."""
    e = table(spark, sf_dir, "embeddings")
    width = F.size("embedding") / F.lit(n_frames)
    fr = F.transform(F.sequence(F.lit(0), F.lit(n_frames - 1)),
                     lambda k: F.slice("embedding", (k * width + 1).cast("int"), width.cast("int")))
    return e.select("vec_id", fr.alias("frames"))


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric_log(run, epoch, step, name, value, n_rows) from ``events``:
    run = user, epoch = day of the event, step = event id, name = event type,
    n_rows = 1 + event_id mod 4 (the batch size the value was averaged over)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("run"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("int").alias("epoch"),
        F.col("event_id").cast("bigint").alias("step"),
        F.col("event_type").alias("name"),
        F.col("value").cast("double").alias("value"),
        (F.lit(1) + F.pmod(F.col("event_id"), F.lit(4))).cast("bigint").alias("n_rows"),
    )


def fallible(spark: SparkSession, sf_dir: str, seed: int = SEED, bad_rate: float = 0.08) -> DataFrame:
    """fallible(event_id, raw): the value as text, replaced by 'bad' on keyed rows."""
    ev = table(spark, sf_dir, "events")
    raw = F.when(rng.uniform(seed, "bad", F.col("event_id")) < F.lit(bad_rate), F.lit("bad")) \
        .otherwise(F.col("value").cast("string"))
    return ev.select(F.col("event_id").cast("bigint").alias("event_id"), raw.alias("raw"))
