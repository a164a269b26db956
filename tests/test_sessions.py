"""SQL functions, streams of metrics, stored sketches and published tables."""

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lexiflow.functions.sql import register_sql
from lexiflow.operators import metrics as M
from lexiflow.operators import sketches as sk
from lexiflow.sources import publish as pb
from lexiflow.streaming import metrics as sm


def test_sql_functions(spark):
    register_sql(spark)
    spark.createDataFrame([(1, "a b c", "a x c d"), (2, None, "a"), (3, "a", None), (4, "", ""), (5, "q", "")], "i int, hyp string, ref string").createOrReplaceTempView("t_sql")
    rows = {r["i"]: r for r in spark.sql("select i, wer(hyp, ref) as w, error_counts(hyp, ref) as k from t_sql").collect()}
    assert tuple(rows[1]["w"]) == (2, 4, 0.5) and tuple(rows[1]["k"]) == (2, 1, 1, 0)
    assert tuple(rows[2]["w"]) == (None,) * 3 and tuple(rows[3]["k"]) == (None,) * 4
    assert tuple(rows[4]["w"]) == (0, 0, None) and tuple(rows[5]["w"]) == (1, 0, None) and tuple(rows[5]["k"]) == (0, 0, 0, 1)
    words = spark.sql("select i, a.* from t_sql, lateral aligned_words(hyp, ref) a order by i, ref_pos, hyp_pos").collect()
    assert [tuple(r) for r in words] == [(1, "=", 0, 0, "a", "a"), (1, "S", 1, 1, "b", "x"), (1, "=", 2, 2, "c", "c"), (1, "D", 3, 3, None, "d"), (5, "I", 0, 0, "q", None)]


# -- streams ------------------------------------------------------------------

T0 = dt.datetime(2024, 1, 1)


def steps():
    rnd = random.Random(2)
    rows = [(f"r{run}", epoch, run * 1000 + epoch * 10 + s, "loss", round(rnd.random() / (1 + min(epoch, 7)), 4), 1 + s % 3, T0 + dt.timedelta(hours=epoch, minutes=5 * s))
            for run in range(3) for epoch in range(14) for s in range(8)]
    return rows


def write_steps(spark, rows, path, files):
    for i in range(files):
        spark.createDataFrame(rows[i::files], sm.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_the_batch_query(spark, scratch):
    rows = steps()
    random.Random(3).shuffle(rows)  # every file holds steps of all times
    write_steps(spark, rows, f"{scratch}/log", 5)
    stream = sm.epoch_metrics_stream(sm.read_metric_stream(spark, f"{scratch}/log", files_per_batch=1), late="2 days")
    query = sm.write_latest(stream, f"{scratch}/out", f"{scratch}/ck")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 4
    got = {(r["run"], r["epoch"], r["name"]): (round(r["value"], 9), r["n_rows"], r["n_steps"]) for r in sm.read_latest(spark, f"{scratch}/out", ["run", "epoch", "name"]).collect()}
    want = M.epoch_metrics(spark.createDataFrame(rows, sm.LOG_SCHEMA)).collect()
    assert got == {(r["run"], r["epoch"], r["name"]): (round(r["value"], 9), r["n_rows"], r["n_steps"]) for r in want}
    # Later files go on from the state.
    more = [("r0", 3, 99_999, "loss", 5.0, 2, T0 + dt.timedelta(hours=13))]
    write_steps(spark, more, f"{scratch}/log", 1)
    sm.write_latest(sm.epoch_metrics_stream(sm.read_metric_stream(spark, f"{scratch}/log", files_per_batch=1), late="2 days"), f"{scratch}/out", f"{scratch}/ck")
    one = sm.read_latest(spark, f"{scratch}/out", ["run", "epoch", "name"]).where("run = 'r0' and epoch = 3").first()
    assert one["n_steps"] == 9


def test_steps_after_the_watermark_are_dropped(spark, scratch):
    rows = steps()
    write_steps(spark, [r for r in rows if r[1] < 13], f"{scratch}/log", 1)
    stream = sm.epoch_metrics_stream(sm.read_metric_stream(spark, f"{scratch}/log", files_per_batch=1), late="1 hour", epoch_length="1 hour")
    sm.write_latest(stream, f"{scratch}/out", f"{scratch}/ck")
    late = [("r0", 0, 77, "loss", 9.0, 1, T0)]  # twelve hours behind
    write_steps(spark, [r for r in rows if r[1] == 13], f"{scratch}/log", 1)
    write_steps(spark, late, f"{scratch}/log", 1)
    stream = sm.epoch_metrics_stream(sm.read_metric_stream(spark, f"{scratch}/log", files_per_batch=1), late="1 hour", epoch_length="1 hour")
    sm.write_latest(stream, f"{scratch}/out", f"{scratch}/ck")
    got = sm.read_latest(spark, f"{scratch}/out", ["run", "epoch", "name"])
    assert got.where("run = 'r0' and epoch = 0").first()["n_steps"] == 8 and got.count() == 42
    assert got.where("epoch = 13").first()["closed"] == T0 + dt.timedelta(hours=14)


@pytest.mark.parametrize("mode", ["min", "max"])
def test_stops_of_a_stream(spark, scratch, mode):
    rows = [(r["run"], r["epoch"], r["name"], r["value"]) for r in M.epoch_metrics(spark.createDataFrame(steps(), sm.LOG_SCHEMA)).collect()]
    schema = "run string, epoch int, name string, value double"
    for part in range(4):
        mine = [r for r in rows if r[1] % 14 // 4 == part]
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        sm.write_latest(sm.early_stop_stream(sm.read_metric_stream(spark, f"{scratch}/in", schema=schema), "loss", 3, mode), f"{scratch}/out", f"{scratch}/ck")
    got = sm.read_latest(spark, f"{scratch}/out", ["run"]).select("run", "best_epoch", F.round("best_value", 9), "stop_epoch", "n_epochs").collect()
    want = M.early_stop(spark.createDataFrame(rows, schema), "loss", 3, mode).select("run", "best_epoch", F.round("best_value", 9), "stop_epoch", "n_epochs").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and any(r["stop_epoch"] is not None for r in want)


# -- sketches -----------------------------------------------------------------

def test_merged_sketches_keep_their_bounds(spark, scratch):
    df = spark.range(30_000).selectExpr("id % 7 as f", "cast(id % 9000 as string) as s", "id * id % 10007 as x", "if(id % 10 = 0, null, id) as y")
    sk.column_sketches(df, ["s", "x", "y"], "f").write.parquet(f"{scratch}/s")
    stored = spark.read.parquet(f"{scratch}/s")
    assert stored.count() == 21
    whole = {r["column"]: r for r in sk.estimates(sk.merge_sketches(stored)).collect()}
    direct = {r["column"]: r for r in sk.estimates(sk.merge_sketches(sk.column_sketches(df.withColumn("f", F.lit(0)), ["s", "x", "y"], "f"))).collect()}
    for c in ("s", "x", "y"):
        true = df.select(F.count_distinct(c)).first()[0]
        values = sorted(len(r[0]) if c == "s" else r[0] for r in df.select(c).collect() if r[0] is not None)
        for got in (whole[c], direct[c]):
            assert got["n_rows"] == 30_000 and got["n_nulls"] == (3000 if c == "y" else 0)
            assert abs(got["n_distinct"] - true) <= true * sk.DISTINCT_ERROR
            for q in (25, 50, 75):
                under, upto = (sum(v < got[f"q_{q}"] for v in values), sum(v <= got[f"q_{q}"] for v in values))
                assert under <= (q / 100 + sk.RANK_ERROR) * len(values) and upto >= (q / 100 - sk.RANK_ERROR) * len(values)


def test_frequent_items_are_bounded_and_whole(spark, scratch):
    df = spark.range(20_000).selectExpr("id % 5 as f", "case when id % 3 = 0 then 'third' when id % 5 = 1 and id % 2 = 0 then 'one_file' when id % 41 = 0 then null else concat('x', id % 900) end as v")
    sk.frequent_items(df, "v", "f", 0.02).write.parquet(f"{scratch}/i")
    stored = spark.read.parquet(f"{scratch}/i")
    assert stored.groupBy("f").count().agg(F.max("count")).first()[0] <= 51
    found = {r["item"]: (r["low"], r["high"]) for r in sk.merge_items(stored, "f", 0.02).collect()}
    counts = {r["v"]: r["count"] for r in df.where("v is not null").groupBy("v").count().collect()}
    assert {v for v, n in counts.items() if n > 400} <= set(found)
    assert all(low <= counts[v] <= high for v, (low, high) in found.items())


# -- published tables -----------------------------------------------------------

def test_readers_keep_their_version(spark, scratch):
    root = f"{scratch}/t"
    assert pb.versions(spark, root) == []
    with pytest.raises(ValueError):
        pb.read_published(spark, root)
    assert pb.publish(spark.range(10), root) == 1
    reader = pb.read_published(spark, root)
    assert pb.publish(spark.range(20), root) == 2 and pb.publish(spark.range(30), root) == 3
    assert reader.count() == 10 and pb.read_published(spark, root).count() == 30 and pb.read_published(spark, root, 2).count() == 20
    assert pb.publish(spark.range(40), root) == 4 and pb.versions(spark, root) == [2, 3, 4]
    with pytest.raises(ValueError):
        pb.read_published(spark, root, 1)
    assert pb.materialize_published(spark.range(99), root).count() == 40
    assert pb.materialize_published(spark.range(99), root, overwrite=True).count() == 99
    fs, path = pb._fs(spark, root)
    assert len(fs.listStatus(path(f"{root}/data"))) == 3  # the data of dropped versions is gone


def test_a_failed_write_publishes_nothing(spark, scratch):
    root = f"{scratch}/t"
    pb.publish(spark.range(5), root)
    with pytest.raises(Exception):  # noqa: B017 - whatever the write raises
        pb.publish(spark.range(5).select(F.raise_error(F.lit("no")).cast("string").alias("x")), root)
    assert pb.versions(spark, root) == [1] and pb.read_published(spark, root).count() == 5


def test_two_writers_get_numbers_of_their_own(spark, scratch):
    root = f"{scratch}/t"
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda n: (pb.publish(spark.range(n), root, keep=100), n), range(1, 13)))
    assert sorted(v for v, _ in got) == list(range(1, 13))
    for v, n in got:
        assert pb.read_published(spark, root, v).count() == n
