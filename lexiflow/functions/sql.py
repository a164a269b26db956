"""The metrics and alignments as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.functions.align import _KINDS, _PAIR, aligned_words, error_kinds
from lexiflow.functions.editdist import word_edit_distance

_WER = T.StructType([T.StructField("errors", T.LongType()), T.StructField("ref_words", T.LongType()), T.StructField("wer", T.DoubleType())])


def _wer_row(h: str | None, r: str | None) -> tuple:
    if h is None or r is None:
        return None, None, None
    words = r.split()
    errors = word_edit_distance(h.split(), words)
    return errors, len(words), errors / len(words) if words else None


@F.pandas_udf(_WER)
def wer_sql(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_wer_row(h, r) for h, r in zip(hyp, ref)], columns=_WER.names).astype({"errors": "Int64", "ref_words": "Int64", "wer": "float64"})


@F.pandas_udf(_KINDS)
def error_counts_sql(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 4 if h is None or r is None else error_kinds(h.split(), r.split()) for h, r in zip(hyp, ref)]
    return pd.DataFrame(rows, columns=_KINDS.names).astype("Int64")


class _AlignedWords:
    """A row per aligned word: op, hyp_pos, ref_pos, hyp_word, ref_word."""

    def eval(self, hyp: str, ref: str) -> Iterator[tuple]:
        for p in aligned_words(hyp, ref) or []:
            yield tuple(p.values())


def register_sql(spark: SparkSession) -> None:
    """Make ``wer(hyp, ref)`` (struct of errors, ref_words, wer), ``error_counts(hyp, ref)`` (struct of hits, substitutions,
    deletions, insertions) and the table function ``aligned_words(hyp, ref)`` known to ``spark.sql``."""
    spark.udf.register("wer", wer_sql)
    spark.udf.register("error_counts", error_counts_sql)
    spark.udtf.register("aligned_words", F.udtf(_AlignedWords, returnType=T.StructType(_PAIR.fields)))
