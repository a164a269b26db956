"""Gates for SQL functions, streams of metrics, stored sketches and published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions.sql import register_sql
from lexiflow.operators import metrics as M
from lexiflow.operators import sketches as sk
from lexiflow.plans import sqlfrag as q
from lexiflow.plans.gates.alignment import _TURNS
from lexiflow.plans.gates.training import PATIENCE
from lexiflow.plans.registry import ORACLE, register
from lexiflow.sources import fixtures as fx
from lexiflow.sources import publish as pb
from lexiflow.sources.io import scratch_path
from lexiflow.sources.tables import table
from lexiflow.streaming import metrics as sm


# ------------------------------------------------------------ SQL functions ----
@register("wer_sql", f"""with {q.turns_cte()},
a as (select conv_id, turn, r, {q.alignment('h', 'r', 'k')} as k from turns)
select conv_id, turn, k.d as errors, len(r)::bigint as ref_words, round(case when len(r) > 0 then k.d::double / len(r) end, 6) as wer,
  k.s as substitutions, k.x as deletions, k.n as insertions from a""")
def q_wer_sql(spark, sf):
    register_sql(spark)
    fx.noisy_turns(spark, sf).createOrReplaceTempView("lexiflow_turns")
    return spark.sql("""select conv_id, turn, w.errors, w.ref_words, round(w.wer, 6) as wer, k.substitutions, k.deletions, k.insertions
        from (select conv_id, turn, wer(hyp, ref) as w, error_counts(hyp, ref) as k from lexiflow_turns)""")


@register("aligned_words_sql", _TURNS + """
select case when x.op <> 'I' then r[x.j + 1] end as ref_word, x.op as op, count(*)::bigint as n from err group by all""")
def q_aligned_words_sql(spark, sf):
    """The table function: words of the references that are left out, replaced, or followed by an added one."""
    register_sql(spark)
    fx.noisy_turns(spark, sf).createOrReplaceTempView("lexiflow_turns")
    return spark.sql("""select a.ref_word, a.op, count(*) as n from lexiflow_turns t, lateral aligned_words(t.hyp, t.ref) a
        where a.op <> '=' group by all""")


# ------------------------------------------------------------------ streams ----
STREAM_FILES = 12


def _log_stream(spark, sf):
    """The metric log as files in no order of time, some per trigger."""
    path = scratch_path(spark, "metric-log")
    ts = table(spark, sf, "events").select(F.col("event_id").cast("bigint").alias("step"), F.col("ts").cast("timestamp").alias("ts"))
    rows = fx.metric_log(spark, sf).join(ts, "step").select(*[f.name for f in sm.LOG_SCHEMA.fields])
    rows.repartition(STREAM_FILES, F.xxhash64("step")).write.parquet(path)
    return sm.read_metric_stream(spark, path, files_per_batch=4)


@register("epoch_metrics_stream", ORACLE["epoch_metrics"])
def q_epoch_metrics_stream(spark, sf):
    """All steps arrive late for some trigger; the watermark waits longer than the log spans, so the sums are the batch query's."""
    out = scratch_path(spark, "epochs")
    sm.write_latest(sm.epoch_metrics_stream(_log_stream(spark, sf), late="3650 days"), out, f"{out}-checkpoint")
    return sm.read_latest(spark, out, ["run", "epoch", "name"]).withColumn("value", F.round("value", 6))


@register("early_stop_stream", ORACLE["early_stop"])
def q_early_stop_stream(spark, sf):
    """Closed epochs in order of their number, several triggers; the last state of each run is the batch query's row."""
    path, out = scratch_path(spark, "closed"), scratch_path(spark, "stops")
    epochs = M.epoch_metrics(fx.metric_log(spark, sf)).select("run", "epoch", "name", "value")
    lo, hi = epochs.agg(F.min("epoch"), F.max("epoch")).first()
    part = F.floor((F.col("epoch") - (lo or 0)) * 3 / ((hi or 0) - (lo or 0) + 1))
    for i in range(3):  # one file each, in the order in which epochs close
        epochs.where(part == i).coalesce(1).write.mode("append").parquet(path)
    stream = sm.read_metric_stream(spark, path, files_per_batch=1, schema="run string, epoch int, name string, value double")
    sm.write_latest(sm.early_stop_stream(stream, "click", PATIENCE), out, f"{out}-checkpoint")
    return sm.read_latest(spark, out, ["run"]).withColumn("best_value", F.round("best_value", 6)).withColumn("n_epochs", F.col("n_epochs").cast("bigint"))


# ----------------------------------------------------------------- sketches ----
_COLS = ("doc_id", "n_chars", "source", "text")
RANKS = (0.25, 0.5, 0.75)


@register("profile_sketches", " union all ".join(f"""select '{c}' as "column", count(*)::bigint as n_rows, count(*) filter ({c} is null)::bigint as n_nulls,
  true as distinct_within, true as quantiles_within, 16::bigint as n_files from documents""" for c in _COLS))
def q_profile_sketches(spark, sf):
    """Sketches of 16 parts, stored and merged; estimates of the merged ones against exact counts and ranks."""
    part = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
    docs = table(spark, sf, "documents").select(*_COLS, part.alias("part"))
    path = scratch_path(spark, "sketches")
    sk.column_sketches(docs, _COLS, "part").write.parquet(path)
    stored = spark.read.parquet(path)
    merged = sk.estimates(sk.merge_sketches(stored), RANKS).join(stored.groupBy("column").agg(F.count(F.lit(1)).alias("n_files")), "column").drop("distinct", "quantiles")
    rows = docs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"), sk._number(docs, c).alias("x")) for c in _COLS])).alias("c"))
    rows = rows.select("c.*").join(F.broadcast(merged.select("column", *[f"q_{round(100 * r)}" for r in RANKS])), "column")  # one row per column
    exact = rows.groupBy("column").agg(F.count_distinct("v").alias("true_distinct"),
                                       *[F.avg((F.col("x") < F.col(f"q_{round(100 * r)}")).cast("double")).alias(f"under_{i}") for i, r in enumerate(RANKS)],
                                       *[F.avg((F.col("x") <= F.col(f"q_{round(100 * r)}")).cast("double")).alias(f"upto_{i}") for i, r in enumerate(RANKS)])
    good = F.lit(True)
    for i, r in enumerate(RANKS):
        good = good & (F.col(f"under_{i}") <= r + sk.RANK_ERROR) & (F.col(f"upto_{i}") >= r - sk.RANK_ERROR)
    near = F.abs(F.col("n_distinct") - F.col("true_distinct")) <= F.greatest(F.lit(1.0), F.col("true_distinct") * sk.DISTINCT_ERROR)
    return merged.join(exact, "column").select("column", "n_rows", "n_nulls", near.alias("distinct_within"), good.alias("quantiles_within"), "n_files")


@register("frequent_items", f"""select w as item, count(*)::bigint as n, true as within from (select unnest({q.words('text')}) as w from documents) group by w
having count(*) > {sk.ITEM_SHARE}::double * (select sum(len({q.words('text')})) from documents)""")
def q_frequent_items(spark, sf):
    """Words with more than a hundredth of all words, from counters of each source's words; the true counts lie within the bounds."""
    from lexiflow.functions.text import words

    rows = table(spark, sf, "documents").select("source", F.explode(words("text")).alias("word"))
    path = scratch_path(spark, "items")
    sk.frequent_items(rows, "word", "source").write.parquet(path)
    found = sk.merge_items(spark.read.parquet(path), "source")
    counts = rows.groupBy(F.col("word").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    total = spark.read.parquet(path).where("item is null").agg(F.sum("n_rows")).first()[0] or 0
    return found.join(counts, "item").where(F.col("n") > sk.ITEM_SHARE * total).select("item", "n", ((F.col("low") <= F.col("n")) & (F.col("n") <= F.col("high"))).alias("within"))


# ------------------------------------------------------------- quoted CSV ----
@register("scan_quoted_pairs", f"""with {q.pairs_cte()} select row_id, path, hyp, ref from pairs""")
def q_scan_quoted_pairs(spark, sf):
    """All pairs written as CSV, whose references hold line breaks, and read back in byte ranges."""
    from lexiflow.sources.io import write_pairs
    from lexiflow.sources.quoted_csv import read_quoted_pairs

    pairs, path = fx.pairs(spark, sf), scratch_path(spark, "quoted")
    write_pairs(pairs, path)
    return read_quoted_pairs(spark, path, schema=pairs.schema)


# --------------------------------------------------------- published tables ----
@register("published_table", "select doc_id, n_chars, 2 as version, 2 as kept from documents")
def q_published_table(spark, sf):
    """Two versions published one after the other; the one read first stays whole, the newest is returned."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    root = scratch_path(spark, "published")
    pb.publish(docs.withColumn("n_chars", F.lit(0).cast("bigint")), root, keep=2)
    first = pb.read_published(spark, root)
    version = pb.publish(docs, root, keep=2)
    if first.where("n_chars <> 0").count() or first.count() != docs.count():
        raise RuntimeError("a published version changed under its reader")
    return pb.read_published(spark, root).withColumn("version", F.lit(version)).withColumn("kept", F.lit(len(pb.versions(spark, root))))
