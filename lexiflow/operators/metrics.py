"""Metric tables: epoch means of step metrics, early-stopping points, loss over
positions and the word error rate of score tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiflow.functions._util import col_of
from lexiflow.functions.arrays import argmax, cross_entropy
from lexiflow.functions.wer import wer
from lexiflow.operators.udf import register_metric


def epoch_metrics(metrics: DataFrame, keys=("run", "epoch", "name")) -> DataFrame:
    """Mean of each metric per epoch, weighted by the rows behind each step.
    A plain group-by: partial sums before the shuffle, so a hot run costs one
    row per partition."""
    return (metrics.groupBy(*keys)
            .agg(F.try_divide(F.sum(F.col("value") * F.col("n_rows")), F.sum("n_rows").cast("double")).alias("value"),
                 F.sum("n_rows").cast("bigint").alias("n_rows"),
                 F.count(F.lit(1)).cast("bigint").alias("n_steps")))


def early_stop(epochs: DataFrame, name: str, patience: int = 5, mode: str = "min",
               run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Per run: the first epoch at which ``patience`` epochs in a row brought no
    strict improvement of metric ``name`` (NULL if never), and the best epoch
    up to that point.  Windows are partitioned by run over the epoch table."""
    e = epochs.where(F.col("name") == name).select(run, epoch, "value")
    v = F.col("value") if mode == "min" else -F.col("value")
    w = Window.partitionBy(run).orderBy(epoch)
    prior_best = F.min(v).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_k", F.row_number().over(w)) \
        .withColumn("_improved", prior_best.isNull() | (v < prior_best))
    e = e.withColumn("_last_imp", F.max(F.when(F.col("_improved"), F.col("_k"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("_wait", F.col("_k") - F.col("_last_imp"))
    stop = e.where(F.col("_wait") >= patience).groupBy(run).agg(F.min("_k").alias("_stop_k"))
    e = e.join(stop, run, "left")
    upto = e.where(F.col("_stop_k").isNull() | (F.col("_k") <= F.col("_stop_k")))
    best = upto.groupBy(run).agg(
        F.min_by(F.struct(F.col(epoch), F.col("value")), F.struct(v.alias("_v"), F.col("_k"))).alias("_b"),
        F.min(F.when(F.col("_k") == F.col("_stop_k"), F.col(epoch))).alias("stop_epoch"),
        F.count(F.lit(1)).cast("bigint").alias("n_epochs"))
    return best.select(run, F.col("_b").getField(epoch).alias("best_epoch"),
                       F.col("_b.value").alias("best_value"), "stop_epoch", "n_epochs")


def cross_entropy_mean(df: DataFrame, logits: str, target: str, by: Sequence[str] = (), ignore: int = -100) -> DataFrame:
    """Mean cross-entropy per group over the positions (rows) whose target is not
    ``ignore``, and their number.  A group of ignored positions only has a NULL loss."""
    counted = F.col(target) != F.lit(ignore)
    loss = F.when(counted, cross_entropy(logits, F.when(counted, F.col(target)).otherwise(F.lit(0))))
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"), F.count(loss).alias("n_positions"))


def score_wer(scores, labels, decode: Callable[[Column], Column]) -> Column:
    """Metric of a score table: best id per step of ``scores`` (array of vectors), both id
    lists decoded to text, and their word error rate."""
    best = F.transform(col_of(scores), lambda v: argmax(v))
    return wer(decode(best), decode(col_of(labels)))


register_metric("score_wer", score_wer)
