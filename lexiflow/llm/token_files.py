"""Token files: frequency-ranked ids in byte-aligned variable-length code.

A block holds consecutive documents.  Its control stream has two bits per id (the number
of data bytes less one, four ids to a byte), its data stream the ids' ranks by corpus
frequency, little-endian, so the 256 most frequent ids take one byte.  Both decode by
numpy table lookup.  Blocks are rows of Parquet files in one folder per table (``blocks``, ``ranks``);
shards follow one another in ascending order of ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import COMPACT, process_cache, scratch_path, stored, text_batches
from lexiflow.llm.tokens import WordMemo, vocab_path

#: Ids of a block, about (a document is never split).
BLOCK_IDS = 262_144
#: Data bytes of each of a control byte's four ids.
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of ranks (below 2**32)."""
    r = ranks.astype(np.uint32)
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[:len(r)] = extra
    q = padded.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    at = np.zeros(len(r), np.int64)
    np.cumsum(extra[:-1] + np.int64(1), out=at[1:])
    data = np.zeros(int(extra.sum(dtype=np.int64)) + len(r), np.uint8)
    data[at] = r & 0xFF
    for i in range(1, int(extra.max(initial=0)) + 1):
        more = np.flatnonzero(extra >= i)
        data[at[more] + i] = r[more] >> np.uint32(8 * i) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.zeros(n, np.int64)
    np.cumsum(lengths[:-1], out=at[1:], dtype=np.int64) if n else None
    out = raw[at].astype(np.uint32)
    for i in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > i)
        out[more] |= raw[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def _token_rows(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id_col, n, ids (little-endian 16-bit, whole text and end id)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, end = process_cache(f"memo:{path}", lambda: WordMemo(path)), np.array([end_id], "<u2").tobytes()
        for b in batches:
            ids = [x + end for x in memo.encode(list(b["text"]))]
            yield pd.DataFrame({id_col: b["id"], "n": [len(x) // 2 for x in ids], "ids": ids})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"`{id_col}` {kind}, n long, ids binary")


def frequency_ranks(tokens: DataFrame) -> DataFrame:
    """(id, rank) of every id that occurs, by falling count (ties: smaller id); at most as many rows as the vocabulary."""
    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b["ids"]), "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    counts = tokens.select("ids").mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"))  # one row per id


def write_token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id",
                      text_col: str = "text") -> str:
    """Encode every text, write the files below ``path`` and return it.

    Three steps: encode (scan order, to the shared folder), count ids, and a range shuffle by id
    whose tasks write the blocks.  Texts are tokenised once.  A vocabulary must have fewer than 65,536 ids.

    NULL text counts as empty (the end id only).  Rows of a NULL id come first; rows of equal ids follow one another (by
    their ids' hash).  An empty table writes no blocks; other columns are not read."""
    spark = docs.sparkSession
    text_batches(spark)
    path = path or scratch_path(spark, "token-files")
    tokens = stored(_token_rows(docs, tokenizer or vocab_path("word_bpe_49k.json"), end_id, id_col, text_col), "tokens")
    ranks = frequency_ranks(tokens)
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    ranks = spark.read.parquet(f"{path}/ranks").toPandas()
    rank = np.zeros(1 << 16, np.uint32)
    rank[ranks["id"].to_numpy(np.int64)] = ranks["rank"].to_numpy(np.uint32)
    sent = spark.sparkContext.broadcast(rank)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        # Blocks are numbered within the task's shard; first: ids of the shard before the block.
        table, block, first, docs_, sizes, parts, waiting = sent.value, 0, 0, [], [], [], 0

        def flush():
            control, data = encode_block(table[np.frombuffer(b"".join(parts), "<u2")])
            return pd.DataFrame({"block": [block], "first": [first], "n": [waiting], "docs": [docs_], "sizes": [sizes],
                                 "control": [control], "data": [data]})

        for b in batches:
            for doc, n, ids in zip(b["id"], b["n"], b["ids"]):
                docs_.append(None if pd.isna(doc) else doc), sizes.append(n), parts.append(ids)
                waiting += n
                if waiting >= BLOCK_IDS:
                    yield flush()
                    block, first, docs_, sizes, parts, waiting = block + 1, first + waiting, [], [], [], 0
        if parts:
            yield flush()

    shards = max(1, -(-tokens.agg(F.sum("n")).first()[0] // (64 * BLOCK_IDS))) if tokens.limit(1).count() else 1
    shards = max(shards, spark.sparkContext.defaultParallelism)
    rows = tokens.select(F.col(id_col).alias("id"), "n", "ids", F.xxhash64("ids").alias("h"))
    rows = rows.repartitionByRange(int(shards), "id", "h").sortWithinPartitions("id", "h").select("id", "n", "ids")
    blocks = rows.mapInPandas(run, f"block long, first long, n long, docs array<{kind}>, sizes array<long>, control binary, data binary")
    blocks.withColumn("shard", F.spark_partition_id()).write.options(**COMPACT).parquet(f"{path}/blocks")
    return path


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document from the files: id_col, start, n_tokens, ids_crc32 (and ids)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").toPandas()
    ids = np.zeros(max(1, len(ranks)), np.uint32)
    ids[ranks["rank"].to_numpy(np.int64)] = ranks["id"].to_numpy(np.uint32)
    sent = spark.sparkContext.broadcast(ids)
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    # One number per shard (there are as many shards as tasks wrote).
    ends = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect())
    before, total = {}, 0
    for shard, n in ends:
        before[shard], total = total, total + n

    def run(batches):
        for b in batches:
            for shard, first, n, docs, sizes, control, data in zip(b["shard"], b["first"], b["n"], b["docs"], b["sizes"], b["control"], b["data"]):
                raw = sent.value[decode_block(control, data, n)].astype("<u4").tobytes()
                end = np.cumsum(sizes)
                start = end - sizes
                cut = [raw[4 * s:4 * e] for s, e in zip(start.tolist(), end.tolist())]
                out = pd.DataFrame({id_col: pd.Series(list(docs), dtype="object"), "start": before[shard] + first + start, "n_tokens": sizes,
                                    "ids_crc32": [zlib.crc32(x) for x in cut]})
                if with_ids:
                    out["ids"] = [np.frombuffer(x, "<u4").astype(np.int32) for x in cut]
                yield out

    schema = f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return blocks.mapInPandas(run, schema)
