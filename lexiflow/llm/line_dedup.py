"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference counts.

The index holds, in the shared folder, which document holds which line key (postings), how many
documents hold a key and the smallest of them (counts), and a cuckoo filter per shard with the
keys of two or more documents.  Documents go in and out; the filters follow the counts."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import key_filter, skew_join, stored, test_filter, text_key

#: Lines of fewer code points are never dropped.
MIN_CHARS = 10
#: Keys per filter shard, about: at least, at most (a 64th of all in between).
SHARD_KEYS = (1 << 10, 1 << 18)
#: Filters of more bytes than this are not sent to tasks; all lines then meet the counts.
FILTER_BYTES = 32 << 20
#: Slots of a bucket; rounds of moving entries until a filter counts as full.
SLOTS, MOVES = 4, 200
#: A NULL id, smaller than any other.
NO_ID = -(1 << 63)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# -- cuckoo filter: a table of buckets with SLOTS 16-bit fingerprints, 0 is free ---------------

def _places(k2: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and first bucket of each key."""
    u = k2.view(np.uint64)
    prints = (u >> np.uint64(48)).astype(np.uint16)
    prints[prints == 0] = 1
    return prints, (u & np.uint64(buckets - 1)).astype(np.int64)


def _other(bucket: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
    """The second bucket; of the second one it is the first again."""
    return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 7) & (buckets - 1))


def filter_contains(table: np.ndarray, k2: np.ndarray) -> np.ndarray:
    prints, at = _places(k2, len(table))
    two = _other(at, prints, len(table))
    return (table[at] == prints[:, None]).any(1) | (table[two] == prints[:, None]).any(1)


def filter_insert(table: np.ndarray, k2: np.ndarray) -> bool:
    """Put the keys in, in place; false if the table is too full (it is then spoilt)."""
    prints, at = _places(k2, len(table))
    for turn in range(MOVES):
        if not len(at):
            return True
        order = np.argsort(at, kind="stable")
        prints, at = prints[order], at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        free = table[at] == 0
        fits = rank < free.sum(1)
        slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
        table[at[fits], slot[fits]] = prints[fits]
        prints, at, rank = prints[~fits], at[~fits], rank[~fits]
        if turn:
            # The first of each bucket takes a slot and moves its entry on.
            first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.empty(0, bool)
            victim = (at[first] + turn) % SLOTS
            moved = table[at[first], victim].copy()
            table[at[first], victim] = prints[first]
            prints[first] = moved
        at = _other(at, prints, len(table))
    return not len(at)


def filter_delete(table: np.ndarray, k2: np.ndarray) -> None:
    """Take keys out that were put in, in place."""
    prints, at = _places(k2, len(table))
    while len(at):
        two = _other(at, prints, len(table))
        # Keys of one print have the same two buckets or none in common: one of each such group a turn.
        group = np.unique(np.stack([prints.astype(np.int64), np.minimum(at, two)]), axis=1, return_index=True)[1]
        p, one, other = prints[group], at[group], two[group]
        here = (table[one] == p[:, None]).any(1)
        bucket = np.where(here, one, other)
        hit = table[bucket] == p[:, None]
        known = hit.any(1)
        table[bucket[known], hit.argmax(1)[known]] = 0
        rest = np.ones(len(at), bool)
        rest[group] = False
        prints, at = prints[rest], at[rest]


def filter_of(k2: np.ndarray) -> np.ndarray:
    """A filter with all of the keys, at most four fifths full."""
    buckets = 1
    while buckets * SLOTS * 0.8 < len(k2):
        buckets *= 2
    while True:
        table = np.zeros((buckets, SLOTS), np.uint16)
        if filter_insert(table, k2):
            return table
        buckets *= 2


# -- index -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class LineIndex:
    """One version of the index; changes give a new version and leave this one readable."""

    postings: DataFrame  # k1, k2, doc
    counts: DataFrame    # k1, k2, n, first
    filters: DataFrame   # shard, entries, slots (binary): keys with n > 1
    shards: int


_KEYS = "k1 long, k2 long"
_FILTERS = "shard int, entries long, slots binary"


def empty_index(spark: SparkSession) -> LineIndex:
    none = lambda s: spark.createDataFrame([], s)
    return LineIndex(none(f"{_KEYS}, doc long"), none(f"{_KEYS}, n long, first long"), none(_FILTERS), 1)


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))


def line_keys(rows: DataFrame, line: str) -> DataFrame:
    """Adds the 128-bit key (k1, k2) of the stripped, lower-cased line; short lines go."""
    rows = rows.withColumn("__key", F.btrim(F.col(line), F.lit(" \t\n\x0b\x0c\r"))).where(F.char_length("__key") >= MIN_CHARS)
    rows = rows.withColumn("__key", F.translate("__key", _UPPER, _LOWER))
    # Two hashes of different seeds.
    return rows.withColumn("k1", F.xxhash64("__key")).withColumn("k2", F.xxhash64(F.lit(7), F.col("__key"))).drop("__key", line)


def _shard(shards: int) -> Column:
    return F.pmod("k1", F.lit(shards)).cast("int").alias("shard")


def _postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lines = docs.select(_doc(id_col).alias("doc"), F.explode(F.split(F.col(f"`{text_col}`"), "\n")).alias("__line"))
    return line_keys(lines, "__line").select("k1", "k2", "doc").distinct()


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))


def _built(keys: DataFrame, shards: int) -> DataFrame:
    """The filter of every shard from the keys (k1, k2)."""
    def build(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": b["shard"].iloc[:1], "entries": [len(b)], "slots": [filter_of(b["k2"].to_numpy(np.int64)).tobytes()]})

    return keys.select(_shard(shards), "k2").groupBy("shard").applyInPandas(build, _FILTERS)


def _refiltered(index: LineIndex, counts: DataFrame, came: DataFrame, went: DataFrame) -> LineIndex:
    """The filters after keys (k1, k2) came to or went from two or more documents, with the new counts."""
    shared = counts.where("n > 1")
    held = (index.filters.agg(F.sum("entries")).first()[0] or 0) + came.count()
    per_shard = min(SHARD_KEYS[1], max(SHARD_KEYS[0], held // 64))
    if held > 2 * index.shards * per_shard:
        # Outgrown: more shards, all filters anew from the counts.
        shards = -(-held // per_shard)
        return replace(index, counts=counts, shards=shards, filters=stored(_built(shared, shards), "filters"))

    def change(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        shard = (old if len(old) else keys)["shard"].iloc[:1]
        out, into = (keys.loc[keys["sign"] == s, "k2"].to_numpy(np.int64) for s in (-1, 1))
        if not len(old):
            return pd.DataFrame({"shard": shard, "entries": [len(into)], "slots": [filter_of(into).tobytes()]})
        table = np.frombuffer(old["slots"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()
        filter_delete(table, out)
        entries = int(old["entries"].iloc[0]) + len(into) - len(out)
        good = filter_insert(table, into)
        return pd.DataFrame({"shard": shard, "entries": [entries], "slots": [table.tobytes() if good else None]})

    keys = came.select(_shard(index.shards), "k2", F.lit(1).alias("sign")).unionByName(went.select(_shard(index.shards), "k2", F.lit(-1).alias("sign")))
    filters = stored(index.filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(change, _FILTERS), "filters")
    full = filters.where("slots is null").select("shard")
    if full.limit(1).count():
        again = _built(shared.join(full, _shard(index.shards) == full["shard"], "left_semi"), index.shards)
        filters = stored(filters.where("slots is not null").unionByName(again), "filters")
    return replace(index, counts=counts, filters=filters)


def insert_documents(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with the lines of ``docs``.  Rows of one id are one document, also across calls; a line that
    a document holds already does not count again.  NULL ids are one document, before all others."""
    new = stored(_postings(docs, id_col, text_col), "postings")
    if not index.postings.limit(1).count():
        counts = stored(_counted(new), "counts")
        return _refiltered(replace(index, postings=new), counts, counts.where("n > 1").select("k1", "k2"), counts.limit(0).select("k1", "k2"))
    fresh = stored(new.join(index.postings, ["k1", "k2", "doc"], "left_anti"), "postings")
    both = index.counts.withColumn("old", F.col("n")).unionByName(_counted(fresh).withColumn("old", F.lit(0).cast("long")))
    counts = stored(both.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("old").alias("old")), "counts")
    came = counts.where("n > 1 and old < 2").select("k1", "k2")
    return _refiltered(replace(index, postings=index.postings.unionByName(fresh)), counts.drop("old"), came, came.limit(0))


def delete_documents(index: LineIndex, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents whose ids ``ids`` lists (others than held ones have no effect): keys
    that they held fall back to the counts and the smallest holder of the documents that remain."""
    out = ids.select(_doc(id_col).alias("doc")).distinct()
    gone = stored(index.postings.join(out, "doc", "left_semi"), "gone")
    rest = stored(index.postings.join(out, "doc", "left_anti").select("k1", "k2", "doc"), "postings")
    touched = gone.select("k1", "k2").distinct()
    again = _counted(skew_join(rest, touched.withColumn("touched", F.lit(True)), ["k1", "k2"], ["doc"], "inner").drop("touched"))
    counts = index.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(again)
    counts = stored(counts, "counts")
    went = index.counts.where("n > 1").join(touched, ["k1", "k2"], "left_semi").select("k1", "k2").join(
        counts.where("n > 1"), ["k1", "k2"], "left_anti")
    return _refiltered(replace(index, postings=rest), counts, counts.limit(0).select("k1", "k2"), stored(went, "went"))


def _maybe_shared(lines: DataFrame, index: LineIndex) -> DataFrame:
    """The lines (k1, k2, ...) whose key the filters hold, by chance or in fact."""
    if (index.filters.agg(F.sum(F.octet_length("slots"))).first()[0] or 0) > FILTER_BYTES:
        return lines
    sc = lines.sparkSession.sparkContext
    tables = sc.broadcast({r["shard"]: bytes(r["slots"]) for r in index.filters.select("shard", "slots").toLocalIterator()})  # at most FILTER_BYTES
    shards = index.shards

    def run(batches):
        held = {s: np.frombuffer(t, np.uint16).reshape(-1, SLOTS) for s, t in tables.value.items()}
        for b in batches:
            k2, shard = b["k2"].to_numpy(np.int64), (b["k1"].to_numpy(np.int64) % shards).astype(np.int64)
            keep = np.zeros(len(b), bool)
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(part) and (table := held.get(int(shard[part[0]]))) is not None:
                    keep[part] = filter_contains(table, k2[part])
            yield b[keep]

    return lines.mapInPandas(run, lines.schema)


def drop_repeated_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, tkey, n_lines, n_dropped, kept_text.  A line goes if the index holds its key in two
    or more documents and this one is not the smallest of them.

    Lines pass the filters first, then the exact counts (hot keys salted); only texts that lose a line are shuffled."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), _doc(id_col).alias("__doc"), text.alias("__text")).withColumn("tkey", text_key("__text"))
    lines = rows.select("__doc", "tkey", F.posexplode(F.split("__text", "\n")).alias("__pos", "__line"))
    met = stored(_maybe_shared(line_keys(lines, "__line"), index), "met")
    shared = index.counts.where("n > 1").select("k1", "k2", "first")
    drops = skew_join(met, shared, ["k1", "k2"], ["__doc", "tkey", "__pos"], "inner").where(F.col("__doc") != F.col("first"))
    drops = stored(drops.groupBy(F.col("__doc").alias("__d"), F.col("tkey").alias("__t")).agg(F.collect_set("__pos").alias("__drop")), "drops")
    drops = drops.withColumn("__rk", F.xxhash64("__d", "__t"))
    rows = test_filter(rows, F.xxhash64("__doc", "tkey"), key_filter(drops, "__rk"), "__maybe")
    # The lines are split below the join, so that no later step splits them again.
    split = rows.where("__maybe").select("__id", "__doc", "tkey", F.split("__text", "\n").alias("__lines"))
    hit = split.join(drops, (F.col("__doc") == F.col("__d")) & (F.col("tkey") == F.col("__t")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__drop", F.array().cast("array<int>")))
    hit = hit.withColumn("__stay", stay)
    hit = hit.select(F.col("__id").alias(id_col), "tkey", F.size("__lines").cast("long").alias("n_lines"),
                     (F.size("__lines") - F.size("__stay")).cast("long").alias("n_dropped"),
                     F.array_join(F.transform("__stay", lambda i: F.get("__lines", i)), "\n").alias("kept_text"))
    clear = rows.where("not __maybe").select(F.col("__id").alias(id_col), "tkey", F.size(F.split("__text", "\n")).cast("long").alias("n_lines"),
                                             F.lit(0).cast("long").alias("n_dropped"), F.col("__text").alias("kept_text"))
    return hit.unionByName(clear)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, tkey, n_lines, n_dropped, kept_text, from an index of all of ``docs``.

    Texts are split at \\n (NULL or empty: one empty line).  A line's key is the line without spaces, tabs and line
    ends at both ends, A-Z lower-cased; keys of at least MIN_CHARS code points that two or more documents hold stay
    in the one of the smallest id only.  Keys are compared by two 64-bit hashes.

    Rows of one id are one document: their lines stand or go together.  NULL ids are one document, smaller than all
    others.  Repeated rows are all reported.  An empty table gives no rows; other columns are not read."""
    index = insert_documents(empty_index(docs.sparkSession), docs, id_col, text_col)
    return drop_repeated_lines(docs, index, id_col, text_col)
