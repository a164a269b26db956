"""The row-wise operators on a stream.

The reference reads finite files only; nothing here keeps state.  Because WER,
noise, pre-tokens and the array functions are column expressions (or an
Arrow-batched pandas UDF), they apply unchanged to a streaming DataFrame:
pairs arriving as files are scored per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexiflow.functions.wer import wer

PAIRS_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("path", T.StringType()),
                             T.StructField("hyp", T.StringType()), T.StructField("ref", T.StringType())])


def read_pair_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema=PAIRS_SCHEMA) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def score(stream: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Row WER on each arriving pair (stateless, append mode)."""
    s = wer(hyp, ref)
    return stream.select("*", s["errors"].alias("errors"), s["ref_words"].alias("ref_words"), s["wer"].alias("wer"))
