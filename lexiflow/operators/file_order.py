"""Row numbers in file order: files by path, rows as they stand in them.  No key is needed,
and repeated rows keep numbers of their own.

A scan knows each row's file, and the place of a row in it: Parquet stores it, and of
other formats a task reads a byte range of a file from front to end.  Counts per file (or
range) become offsets, and offset plus place is the number; nothing is sorted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexiflow.operators.index import split_label
from lexiflow.sources.io import CSV_OPTIONS, scratch_path

#: Files (or byte ranges) whose offsets are broadcast; beyond this they are joined by shuffle.
BROADCAST_PARTS = 200_000
_META = ("_file", "_start", "_place")


def running_total(parts: DataFrame, order: Sequence[str], n: str, out: str) -> DataFrame:
    """Adds the sum of ``n`` over the rows before, in ``order`` (unique).  Range partitions are summed on their own;
    only their totals (one row per partition) meet in one task."""
    ranged = parts.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_pid").agg(F.sum(n).alias("_t"))
    before = totals.select("_pid", F.coalesce(F.sum("_t").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = ranged.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(F.broadcast(before), "_pid")
    return rows.withColumn(out, F.col("_before") + F.col("_in")).drop("_pid", "_in", "_before")


def with_file_index(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", options: Mapping | None = None,
                    schema: T.StructType | str | None = None, keep: Column | None = None, out: str = "idx", total: str | None = None) -> DataFrame:
    """The rows of the files below ``path`` that ``keep`` keeps, with ``out``: their dense number from 0 in file order.

    Whole Parquet files are numbered from the row numbers that they hold, in a second scan.  Other formats, and tables
    with rows left out, are written once to the shared folder with each row's place in its byte range, which
    a second scan could deal otherwise.  ``total`` names a column with the number of rows."""
    reader = spark.read.format(fmt).options(**{**(CSV_OPTIONS if fmt == "csv" else {}), **(options or {})})
    df = (reader.schema(schema) if schema is not None else reader).load(path if isinstance(path, str) else list(path))
    cols = df.columns
    if fmt == "parquet" and keep is None:
        rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("bigint").alias("_start"), F.col("_metadata.row_index").alias("_place"))
        parts = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.lit(0).cast("bigint"))
    else:
        rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
        rows = rows.where(keep) if keep is not None else rows
        stored = scratch_path(spark, "file-order")
        rows.withColumn("_place", F.monotonically_increasing_id()).write.parquet(stored)
        rows = spark.read.parquet(stored)
        parts = rows.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    parts = running_total(parts, ["_file", "_start"], "_n", "_off").checkpoint()
    n_parts, n_rows = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    offsets = parts.select("_file", "_start", (F.col("_off") - F.col("_first")).alias("_off"))
    rows = rows.join(F.broadcast(offsets) if n_parts <= BROADCAST_PARTS else offsets, ["_file", "_start"])
    more = [F.lit(n_rows).cast("bigint").alias(total)] if total else []
    return rows.select(*[F.col(f"`{c}`") for c in cols], (F.col("_off") + F.col("_place")).alias(out), *more)


def file_order_split(spark: SparkSession, path: str | Sequence[str], bounds=(12000, 15000), names=("train", "valid", "test"), out: str = "split",
                     **reading) -> DataFrame:
    """``with_file_index`` and the positional split: rows [0, b1) are names[0], and so on; bounds below 1 are
    fractions of the number of rows."""
    rows = with_file_index(spark, path, total="_total", **reading)
    return rows.withColumn(out, split_label(F.col("idx"), F.col("_total"), bounds, names)).drop("_total")


def file_offset_rows(spark: SparkSession, path: str | Sequence[str], n: int, **reading) -> DataFrame:
    """The rows after the first ``n`` in file order."""
    return with_file_index(spark, path, out="_idx", **reading).where(F.col("_idx") >= n).drop("_idx")
