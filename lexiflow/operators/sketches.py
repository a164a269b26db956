"""Stored sketches of a table's columns, one set per file, merged without reading the files again.

Distinct counts are HyperLogLog sketches, quantiles KLL sketches, and frequent items a
table of the counters of the lossy counting kind: per file the items that hold more than a share
of its rows, with a bound for what any other item can hold."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct sketch, and the relative error that it keeps with near certainty (three deviations).
LG_K = 12
DISTINCT_ERROR = 3 * 1.04 / sqrt(1 << LG_K)
#: Size of a quantile sketch, and the error of a rank that it keeps with near certainty.
KLL_K = 400
RANK_ERROR = 0.012
#: Items of a file with more than this share of its rows are kept.
ITEM_SHARE = 0.01


def column_sketches(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """(by, column, n_rows, n_nulls, distinct, quantiles): one row per group ``by`` (a file, say) and column.

    ``quantiles`` is of the column as a number, or of the length of a text.  One scan and one shuffle of sketches."""
    rows = df.select(by, F.posexplode(F.array(*[F.struct(F.col(f"`{c}`").cast("string").alias("v"), _number(df, c).alias("x")) for c in cols])).alias("i", "c"))
    names = F.array(*[F.lit(c) for c in cols])
    return rows.groupBy(by, F.get(names, F.col("i")).alias("column")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("c.v").isNull()).alias("n_nulls"),
        F.hll_sketch_agg("c.v", LG_K).alias("distinct"), F.kll_sketch_agg_double("c.x", KLL_K).alias("quantiles"))


def _number(df: DataFrame, c: str):
    kind = df.schema[c].dataType.typeName()
    return (F.char_length(F.col(f"`{c}`")) if kind == "string" else F.col(f"`{c}`")).cast("double")


def merge_sketches(stored: DataFrame) -> DataFrame:
    """(column, n_rows, n_nulls, distinct, quantiles) of all groups together, from the stored rows alone."""
    return stored.groupBy("column").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"),
                                        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def estimates(sketches: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Adds n_distinct (estimate) and q_<rank in percent> of each row of sketches."""
    out = sketches.withColumn("n_distinct", F.hll_sketch_estimate("distinct"))
    for r in ranks:
        out = out.withColumn(f"q_{round(100 * r)}", F.kll_sketch_get_quantile_double("quantiles", F.lit(float(r))))
    return out


def frequent_items(df: DataFrame, c: str, by: str, share: float = ITEM_SHARE) -> DataFrame:
    """(by, item, n, n_rows, most): the items of each group with more than ``share`` of its rows, counted exactly, and one row
    with a NULL item and the largest count that any other item has there.  At most 1 / share + 1 rows per group."""
    counts = df.where(F.col(c).isNotNull()).groupBy(by, F.col(c).cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    total = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
    counts = counts.join(total, by).withColumn("kept", F.col("n") > F.col("n_rows") * F.lit(share))
    kept = counts.where("kept").select(by, "item", "n", "n_rows", F.lit(None).cast("bigint").alias("most"))
    rest = total.join(counts.where("not kept").groupBy(by).agg(F.max("n").alias("most")), by, "left")
    return kept.unionByName(rest.select(by, F.lit(None).cast("string").alias("item"), F.lit(None).cast("bigint").alias("n"), "n_rows", F.coalesce("most", F.lit(0)).alias("most")))


def merge_items(stored: DataFrame, by: str, share: float = ITEM_SHARE) -> DataFrame:
    """(item, low, high) of every item that may hold more than ``share`` of all rows: its count lies from ``low`` to ``high``.
    No item with more is missing: one that no group kept has at most ``share`` of each."""
    rest = stored.where("item is null").select(by, "most", "n_rows")
    total = rest.agg(F.sum("n_rows").alias("total"), F.sum("most").alias("unseen"))
    items = stored.where("item is not null").join(rest.select(by, F.col("most").alias("own")), by)
    items = items.groupBy("item").agg(F.sum("n").alias("low"), F.sum("own").alias("own")).crossJoin(F.broadcast(total))  # one row
    return items.select("item", "low", (F.col("low") + F.col("unseen") - F.col("own")).alias("high"), "total").where(F.col("high") > F.col("total") * F.lit(share)).drop("total")
