"""CSV files with quoted line breaks, read in byte ranges by many tasks.

Whether a line starts a record depends on the number of quotes before it, odd or even.  A first scan
counts the quotes of every byte range, so that the second knows at each range's start whether it lies inside a
quoted cell.  Lines that are records of their own go on as they are; only the lines of records
with line breaks are put together, also across ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexiflow.sources.io import CSV_OPTIONS, finish_pairs

#: Byte ranges whose starting states are broadcast; beyond this they are joined by shuffle.
BROADCAST_RANGES = 200_000
_TAGGED = "file string, start long, rec long, pos long, opens boolean, single boolean, value string"


def _tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Record number in the range (0: goes on from before), line number, and whether the line opens, and is, a record."""
    range_, odd, rec, pos = None, 0, 0, 0
    for b in batches:
        parts = []
        change = (b["file"] != b["file"].shift()) | (b["start"] != b["start"].shift())
        for _, run in b.groupby(change.cumsum(), sort=False):
            key = (run["file"].iloc[0], run["start"].iloc[0])
            if key != range_:
                range_, odd, rec, pos = key, int(run["odd"].iloc[0]), 0, 0
            quotes = run["quotes"].to_numpy(np.int64)
            before = (odd + quotes.cumsum() - quotes) % 2
            opens = before == 0
            parts.append(pd.DataFrame({"file": run["file"], "start": run["start"], "rec": rec + opens.cumsum(), "pos": pos + np.arange(len(run)),
                                       "opens": opens, "single": opens & (quotes % 2 == 0), "value": run["value"]}))
            odd, rec, pos = int((odd + quotes.sum()) % 2), int(parts[-1]["rec"].iloc[-1]), pos + len(run)
        if parts:
            yield pd.concat(parts)


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, start, rec, pos, record): every CSV record of the files as text, line breaks within it included."""
    text = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    quotes = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes")
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), quotes, "value")
    ranges = lines.groupBy("file", "start").agg(F.sum("quotes").alias("q")).checkpoint()
    # One row per byte range, windows of one file's ranges.
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = ranges.select("file", "start", F.pmod(F.coalesce(F.sum("q").over(earlier), F.lit(0)), F.lit(2)).cast("int").alias("odd"))
    if ranges.count() <= BROADCAST_RANGES:
        known = lines.join(F.broadcast(state), ["file", "start"])  # the lines stay in the order of the scan
    else:
        known = lines.withColumn("line", F.monotonically_increasing_id()).join(state, ["file", "start"])
        known = known.repartition("file", "start").sortWithinPartitions("file", "start", "line")
    tagged = known.select("file", "start", "odd", "quotes", "value").mapInPandas(_tag, _TAGGED)
    single = tagged.where("single").select("file", "start", "rec", "pos", F.col("value").alias("record"))
    rest = tagged.where("not single")
    # A range that begins inside a record goes on with the last one opened before it.
    opened = rest.groupBy("file", "start").agg(F.max("rec").alias("last"))
    owner = opened.select("file", "start", F.last(F.when(F.col("last") > 0, F.struct(F.col("start").alias("s"), F.col("last").alias("r"))), True).over(earlier).alias("own"))
    heads = rest.where("rec = 0").join(owner, ["file", "start"])
    of = lambda s, r: (F.col(s).alias("s"), F.col(r).alias("r"), F.struct("start", "pos", "value").alias("line"))
    lines = rest.where("rec > 0").select("file", *of("start", "rec")).unionByName(heads.select("file", *of("own.s", "own.r")))
    joined = lines.groupBy("file", "s", "r").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    several = joined.select("file", F.col("s").alias("start"), F.col("r").alias("rec"), F.element_at("lines", 1)["pos"].alias("pos"),
                            F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))
    return single.unionByName(several)


def read_quoted_pairs(spark: SparkSession, path: str | Sequence[str], na_values: Sequence[str] = (), schema: T.StructType | None = None) -> DataFrame:
    """The rows of ``sources.io.read_pairs`` with line breaks in quoted cells, in as many tasks as there are byte ranges.

    Quotes stand around whole cells and are doubled within them, as the sink writes them.  Files share one header."""
    names = spark.read.options(**CSV_OPTIONS).csv(path if isinstance(path, str) else list(path)).columns
    rows = records(spark, path).where("not (start = 0 and rec = 1)")  # the header of every file
    # Carriage returns before line ends go, as with that reader.
    rows = rows.withColumn("record", F.regexp_replace("record", "\r(\n|$)", "$1")).where("record <> ''")
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
    kinds = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    parsed = rows.select(F.from_csv("record", F.lit(kinds), options).alias("r"))
    return finish_pairs(parsed.select("r.*"), na_values, schema)
