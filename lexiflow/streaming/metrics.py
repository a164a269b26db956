"""Epoch means and stopping points of training runs on a stream of step metrics.

Steps come as files in any order.  Epoch sums are keyed state with a watermark on the time of
the step: a late step still counts until the watermark has passed its epoch, and what comes
later is dropped.  Stopping points are kept per run in state of their own, fed by closed epochs in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG_SCHEMA = T.StructType([T.StructField("run", T.StringType()), T.StructField("epoch", T.IntegerType()), T.StructField("step", T.LongType()),
                           T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("n_rows", T.LongType()),
                           T.StructField("ts", T.TimestampType())])


def read_metric_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None, schema=LOG_SCHEMA) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def epoch_metrics_stream(stream: DataFrame, late: str = "1 hour", epoch_length: str | None = None) -> DataFrame:
    """run, epoch, name, value, n_rows, n_steps as in the batch operator.

    In update mode each trigger gives the new state of the epochs it touched.  With ``epoch_length`` (the time an epoch
    spans) an epoch is closed, and in append mode given once, when the watermark passes its window; ``closed`` is that time."""
    rows = stream.withWatermark("ts", late)
    keys = ["run", "epoch", "name"] + ([F.window("ts", epoch_length).alias("w")] if epoch_length else [])
    sums = rows.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("value") * F.col("n_rows")), F.sum("n_rows").cast("double")).alias("value"),
        F.sum("n_rows").cast("bigint").alias("n_rows"), F.count(F.lit(1)).cast("bigint").alias("n_steps"))
    return sums.select("run", "epoch", "name", "value", "n_rows", "n_steps", *([F.col("w.end").alias("closed")] if epoch_length else []))


_STOP = "run string, best_epoch int, best_value double, stop_epoch int, n_epochs long"
_STATE = "best_epoch int, best_value double, last int, waited int, stop_epoch int, n_epochs long"


def early_stop_stream(epochs: DataFrame, name: str, patience: int = 5, mode: str = "min") -> DataFrame:
    """Stopping point of every run whose state changed: the row of the batch operator over the epochs seen so far.

    ``epochs`` is a stream of closed epochs (run, epoch, name, value), each once; of one trigger they are taken in order.
    Epochs before the last one taken come too late to matter and are left out; after the stop nothing changes."""
    sign = 1 if mode == "min" else -1

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best_epoch, best, last, waited, stop, n = state.get if state.exists else (None, None, None, 0, None, 0)
        rows = pd.concat(list(parts)).sort_values("epoch")
        for epoch, value in zip(rows["epoch"].astype(int), rows["value"]):
            if stop is not None or (last is not None and epoch <= last):
                continue
            last, n = epoch, n + 1
            if best is None or sign * value < sign * best:
                best_epoch, best, waited = epoch, float(value), 0
            else:
                waited += 1
                stop = epoch if waited >= patience else None
        state.update((best_epoch, best, last, waited, stop, n))
        yield pd.DataFrame({"run": [key[0]], "best_epoch": pd.array([best_epoch], dtype="Int32"), "best_value": [best],
                            "stop_epoch": pd.array([stop], dtype="Int32"), "n_epochs": [n]})

    mine = epochs.where((F.col("name") == name) & F.col("value").isNotNull()).select("run", "epoch", "value")
    return mine.groupBy("run").applyInPandasWithState(step, _STOP, _STATE, "update", GroupStateTimeout.NoTimeout)


def write_latest(stream: DataFrame, path: str, checkpoint: str):
    """Run an update-mode stream over all files that are there, each trigger's rows to a folder of its own (written again
    whole if the trigger is repeated); returns the finished query."""
    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of every key that ``write_latest`` has written."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*keys, "r.*")
