"""Python escape hatches: per-row error isolation, batched maps, per-batch
collation and user metrics.  All run inside Spark tasks over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_METRICS: dict[str, Callable[..., Column]] = {}


def safe_map(df: DataFrame, fn: Callable, in_col: str, out_type: T.DataType, key: str | None = None,
             out: str = "result") -> DataFrame:
    """Apply ``fn`` to every value of ``in_col``; a row whose call raises gets a
    NULL result and the exception text in ``error`` instead of failing the job."""
    keep = [c for c in df.columns]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, out_type),
                                                           T.StructField("error", T.StringType())])

    def run(batches):
        import pandas as pd
        for pdf in batches:
            res, err = [], []
            for v in pdf[in_col]:
                try:
                    res.append(fn(v))
                    err.append(None)
                except Exception as e:  # noqa: BLE001 - isolation is the point
                    res.append(None)
                    err.append(f"{type(e).__name__}: {e}")
            pdf = pdf.copy()
            pdf[out] = pd.Series(res, dtype="object")
            pdf["error"] = pd.Series(err, dtype="object")
            yield pdf
    return df.mapInPandas(run, schema)


def drop_failed(df: DataFrame, error: str = "error") -> DataFrame:
    return df.where(F.col(error).isNull())


def try_parse_double(c) -> Column:
    """Native path of the same isolation: NULL where the text is not a number."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """Batched map over Arrow record batches (``fn``: pandas DataFrame -> pandas DataFrame)."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def collate(df: DataFrame, keys, fn: Callable, schema) -> DataFrame:
    """Per-batch callable: every group of ``keys`` (e.g. one training batch) is
    handed to ``fn`` as one pandas DataFrame.  Groups must be small (a batch)."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def register_metric(name: str, fn: Callable[..., Column]) -> None:
    """User metric: a Python function that returns a Column expression."""
    _METRICS[name] = fn


def metric(name: str, *cols) -> Column:
    return _METRICS[name](*cols)
