"""Sources and sinks: CSV pair tables, format by extension, named splits,
materialised caches and table profiles."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.session import COMPACT, ensure_checkpoint_dir, shuffles_dropped

# ---- fixed values: texts a pandas CSV reader turns into NaN by default -------
PANDAS_NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# ------------------------------------------------------------------------------

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# What the reader calls a first column whose header is empty, and what pandas calls it when it writes such a table again.
UNNAMED_FIRST = ("_c0", "", "Unnamed: 0")


def read_pairs(spark: SparkSession, path: str, na_values: Sequence[str] = (),
               schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header; columns are taken by name, so a file may hold them in
    any order and hold more.  With a ``schema`` its columns are selected and cast
    (a text that does not cast is NULL).  Blank cells are NULL; ``na_values`` adds
    texts read as NULL (pass ``PANDAS_NA_VALUES`` for pandas parity).  A first
    column without a name (the index a pandas sink writes) is dropped; no other is.
    ``multi_line=False`` lets Spark split large files without quoted line breaks; ``quoted_csv`` splits those with them."""
    return finish_pairs(spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower()).csv(path), na_values, schema)


def finish_pairs(df: DataFrame, na_values: Sequence[str] = (), schema: T.StructType | None = None) -> DataFrame:
    """Text columns of a CSV reader without the unnamed index, NULL texts and casts applied."""
    if df.columns and df.columns[0] in UNNAMED_FIRST:
        df = df.drop(df.columns[0])
    if na_values:
        na = list(na_values)
        df = df.select([F.when(F.col(f"`{c}`").isin(na), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if schema is not None:
        df = df.select([F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return df


def write_pairs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header and no index column; whitespace kept as is."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def format_of(path: str) -> str:
    """Reader name from the file extension: csv and raw are CSV, anything else
    is taken as the format name itself."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet"
    return "csv" if ext in ("csv", "raw") else ext


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    fmt = format_of(path)
    if fmt == "csv":
        return read_pairs(spark, path, schema=schema)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_splits(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType | None = None) -> DataFrame:
    """Several files as one table with a ``split`` column."""
    out = None
    for name, p in paths.items():
        part = read_any(spark, p, schema).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def materialize(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Reuse a parquet table written earlier unless ``overwrite``; the returned
    frame always reads the files (lineage ends at the table)."""
    spark = df.sparkSession
    if overwrite or not exists(spark, path):
        with shuffles_dropped(spark):
            df.write.mode("overwrite").options(**COMPACT).parquet(path)
    return spark.read.parquet(path)


def preview_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def preview(df: DataFrame, n: int = 5) -> list:
    """First ``n`` rows for a look at a large table (the only place a row limit
    is the point); only ``n`` rows reach the driver."""
    return preview_rows(df, n).collect()


def profile(df: DataFrame) -> DataFrame:
    """One row: row count, column count and the NULL count of every column."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    return df.agg(*aggs).withColumn("n_cols", F.lit(len(df.columns)).cast("int"))
