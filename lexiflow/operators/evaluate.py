"""Scoring operators: row WER, WER histogram, system join and WER report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.text import build_path, strip_prefix
from lexiflow.functions.wer import wer


def with_wer(df: DataFrame, hyp: str = "hyp", ref: str = "ref", out: str = "score") -> DataFrame:
    """Attach struct(errors, ref_words, wer) computed row by row (no shuffle)."""
    return df.withColumn(out, wer(hyp, ref))


def wer_rows(df: DataFrame, hyp: str = "hyp", ref: str = "ref", key: str = "row_id") -> DataFrame:
    s = wer(hyp, ref)
    return df.select(key, s["errors"].alias("errors"), s["ref_words"].alias("ref_words"), s["wer"].alias("wer"))


def wer_histogram(df: DataFrame, wer_col: str = "wer", digits: int = 6) -> DataFrame:
    """Rows per exact WER value (rounded to ``digits``), ascending; NULL dropped.

    The group-by runs a partial (map-side) count before the shuffle, so only one
    row per distinct value and partition crosses the network.
    """
    v = F.round(F.col(wer_col), digits)
    return (df.where(F.col(wer_col).isNotNull())
            .groupBy(v.alias("wer"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy("wer"))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.where(cond) if cond is not None else df


def join_systems(a: DataFrame, b: DataFrame, on: str = "path", how: str = "inner") -> DataFrame:
    """Equi-join of two systems' outputs.  SQL semantics: NULL keys never match,
    duplicate keys multiply.  AQE turns it into a broadcast join when one side's
    runtime size is under the threshold and splits skewed key partitions otherwise."""
    return a.join(b, on=on, how=how)


def pseudo_with_path(pseudo: DataFrame, root: str = "", strip: int = 2) -> DataFrame:
    """path = root + output_dir without its first ``strip`` characters + file name."""
    return pseudo.select(
        build_path(root, strip_prefix("output_dir", strip), "audio_part_name").alias("path"),
        F.col("beam"))


def unpivot_systems(df: DataFrame, ids: Sequence[str], systems: Sequence[str],
                    name: str = "system", value: str = "text") -> DataFrame:
    return df.unpivot(list(ids), list(systems), name, value)


def wer_report(scored: DataFrame, by: Sequence[str] = ("system",), score: str = "score",
               digits: int = 6) -> DataFrame:
    """Macro mean of row WER per group (the reference's figure) plus micro WER
    (total errors over total reference words), row count and error totals."""
    s = F.col(score)
    return (scored.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(s["errors"]).alias("errors"),
                 F.sum(s["ref_words"]).alias("ref_words"),
                 F.round(F.avg(s["wer"]), digits).alias("macro_wer"),
                 F.round(F.try_divide(F.sum(s["errors"]).cast("double"),
                                      F.sum(s["ref_words"]).cast("double")), digits).alias("micro_wer")))
