"""Exact deduplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import key_filter, skew_join, stored, test_filter, text_key


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64,
                digest_all: bool = False) -> DataFrame:
    """One row per input row: id_col, tkey, keep_id, group_size, kept, text_sha256.

    1. A narrow scan writes (length, prefix hash) of every row to the shared folder.
    2. Rows whose length nobody shares are done; the others are grouped by
       (length, prefix hash); rows alone there are done too.
    3. The second scan hashes whole texts, only of the rows still in play, and
       groups by that hash (SHA-256) with partial aggregation.

    Between the steps the surviving keys travel as a bit table of constant size;
    a collision there costs an extra hash and never changes the result.  A group
    of any size is one row after pre-aggregation, and its members find it through
    a join with salted hot keys.

    Of equal texts the row with the largest id stays (of rows equal in id too, one).
    NULL text counts as empty; empty texts form a group like any other.  A NULL id is
    the smallest id.  Text hashes are NULL for rows cleared early unless
    ``digest_all``.  An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
    length = F.octet_length("__text").cast("long")
    level = F.xxhash64(length, F.substring("__text", 1, prefix_chars))

    sizes = stored(base.select(length.alias("len"), level.alias("pre")), "lengths")
    by_len = sizes.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("len").alias("k"))
    shared_len = test_filter(sizes, F.xxhash64("len"), key_filter(by_len, "k"), "play").where("play")
    by_pre = shared_len.groupBy("pre").agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    rows = test_filter(base.withColumn("__pre", level), F.col("__pre"), key_filter(by_pre, "pre"), "__play")
    sha = F.sha2(F.col("__text").cast("binary"), 256)
    hashed = stored(rows.select(
        F.col("__id").alias(id_col), text_key("__text").alias("tkey"), F.col("__play").alias("play"),
        F.monotonically_increasing_id().alias("rid"),
        (sha if digest_all else F.when(F.col("__play"), sha)).alias("text_sha256")), "hashed")

    play = hashed.where("play")
    groups = (play.groupBy("text_sha256").agg(F.max(F.struct(id_col, "rid")).alias("best"), F.count(F.lit(1)).alias("n"))
              .where("n > 1"))
    met = skew_join(play, groups, "text_sha256", ["rid"])
    found = met.select(id_col, "tkey", F.when(F.col("n").isNull(), F.col(id_col)).otherwise(F.col(f"best.{id_col}")).alias("keep_id"),
                       F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                       (F.col("n").isNull() | (F.col("best.rid") == F.col("rid"))).alias("kept"), "text_sha256")
    alone = hashed.where("not play").select(id_col, "tkey", F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                            F.lit(True).alias("kept"), "text_sha256")
    return found.unionByName(alone)
