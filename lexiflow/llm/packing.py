"""Packing by power-of-two decomposition: no sequence crosses documents, none is padded."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import text_batches
from lexiflow.llm.tokens import byte_bpe_encoder, vocab_path

#: Bits of a sequence id below its bucket.
ID_BITS = 58
#: A text has less than 2**31 bytes, so no more tokens.
TOKEN_BITS = 31


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: as many of ``longest`` (a power of two) as fit, then the binary digits of the rest."""
    whole = n // longest
    out = [(i * longest, longest) for i in range(whole)]
    at, size = whole * longest, longest >> 1
    while size:
        if n & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def stored_place(docs: DataFrame, out: str) -> DataFrame | None:
    """``docs`` with ``out``, each row's number in the order of the files it is read from; None if it is not a scan of files.

    Spark deals file splits to partitions by size, so only the file names (parts are
    numbered; a longer name is a higher part) and the row's place in its file tell the
    order.  The offsets have one row per file; counting reads no column."""
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return None
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("__file").alias("__f"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = rows.join(F.broadcast(files), F.col("__file") == F.col("__f"))
    return rows.withColumn(out, F.col("__before") + F.col("__row")).drop("__file", "__row", "__f", "__before")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024,
                   end_id: int = 0, with_ids: bool = True, in_stored_order: bool = False) -> DataFrame:
    """One row per sequence: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids).

    Each document (its ids and ``end_id``) is cut into pieces of binary lengths.
    A piece is a sequence of its own, so every sequence is full, none holds two
    documents, and those of one bucket (log2 of the length) batch together without
    padding.  Scan, encode and cut run in one stage: no shuffle, no state across
    documents.  ``sequence_id`` is the bucket in the high bits and a number unique
    in the job below; ids of a bucket are one interval.  With ``in_stored_order`` the
    ids of each bucket follow the rows' order over the files that ``docs`` is read
    from, and are the same in every run; rows that come from no file keep the
    order of their partitions.

    NULL text counts as empty (one sequence that holds ``end_id``).  Rows of NULL or
    repeated ids are packed like all others.  An empty table gives no rows; other
    columns are not read."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    text_batches(docs.sparkSession)
    path = tokenizer or vocab_path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket int, place long" + (", ids array<int>" if with_ids else "")
    place_bits = TOKEN_BITS - (longest.bit_length() - 1)

    def run(batches):
        encode = byte_bpe_encoder(path)
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "place", "ids"]
        for b in batches:
            rows, waiting = [], 0
            for doc, text, place in zip(b["id"], b["text"], b["place"]):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False)
                raw = ids.tobytes()
                for at, n in binary_pieces(len(ids), longest):
                    rows.append((doc, at, n, zlib.crc32(raw[4 * at:4 * (at + n)]), len(ids), n.bit_length() - 1,
                                 (int(place) << place_bits) + at // longest,
                                 ids[at:at + n].astype(np.int32) if with_ids else None))
                waiting += len(ids)
                if waiting > 2_000_000:
                    yield frame(rows, names)
                    rows, waiting = [], 0
            if rows:
                yield frame(rows, names)

    def frame(rows, names):
        pdf = pd.DataFrame(rows, columns=names).rename(columns={"id": id_col})
        if pdf[id_col].isna().any():
            pdf[id_col] = pdf[id_col].astype("object").where(pdf[id_col].notna(), None)
        return pdf if with_ids else pdf.drop(columns="ids")

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = stored_place(docs.select(F.col(id_col).alias("id"), text), "place") if in_stored_order else None
    if rows is None:
        packed = docs.select(F.col(id_col).alias("id"), text, F.lit(0).cast("long").alias("place")).mapInPandas(run, schema)
        number = F.monotonically_increasing_id()
    else:
        packed = rows.mapInPandas(run, schema)
        number = F.col("place")
    number = F.shiftleft(F.col("bucket").cast("long"), ID_BITS).bitwiseOR(number)
    packed = packed.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long"))
    return packed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *(["ids"] if with_ids else []))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences in one folder per bucket, so that a reader takes equal lengths."""
    packed.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
