"""File order, epochs by permutation and the join of heavy keys."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import epochs as ep
from lexiflow.operators import file_order as fo
from lexiflow.operators.skew import heavy_keys, join_skewed


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1001, 4099])
def test_slots_are_a_bijection_and_rows_its_inverse(spark, n):
    perm = ep.Permutation(n, seed=9)
    a, b = perm.sides
    assert a * b >= n and a * b - n < a
    for epoch in (0, 1, 5):
        got = spark.range(n).select("id", perm.slot("id", epoch).alias("s")).withColumn("back", perm.row("s", epoch)).collect()
        assert sorted(r["s"] for r in got) == list(range(n))
        assert all(r["back"] == r["id"] for r in got)


def test_epochs_and_seeds_differ(spark):
    orders = [tuple(r[0] for r in spark.range(500).select(ep.Permutation(500, s).slot("id", e)).collect()) for s, e in ((1, 0), (1, 1), (2, 0))]
    assert len(set(orders)) == 3
    for order in orders:
        # Neighbours do not stay neighbours.
        assert sum(abs(x - y) == 1 for x, y in zip(order, order[1:])) < 20


def test_batches_of_an_epoch(spark):
    df = spark.createDataFrame([(i * 3, str(i)) for i in range(101)], "row_id long, text string")
    rows = ep.epoch_batches(df, ["row_id"], 8, [0, 4], seed=3).collect()
    assert len(rows) == 202
    for epoch in (0, 4):
        sizes = Counter(r["batch_id"] for r in rows if r["epoch"] == epoch)
        assert sizes == {**dict.fromkeys(range(12), 8), 12: 5}
        assert len({(r["batch_id"], r["batch_pos"]) for r in rows if r["epoch"] == epoch}) == 101
    plan = ep.batch_columns(spark.range(10).withColumnRenamed("id", "idx"), ep.Permutation(10), 2, [0, 1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    indexed = df.withColumn("idx", F.expr("row_id div 3"))
    perm = ep.Permutation(101, 3)
    for batch in (0, 12, 13):
        got = {(r["row_id"], r["batch_pos"]) for r in ep.batch_rows(indexed, perm, 8, 4, batch).collect()}
        assert got == {(r["row_id"], r["batch_pos"]) for r in rows if r["epoch"] == 4 and r["batch_id"] == batch}
    assert ep.epoch_batches(df.limit(0), ["row_id"], 8, [0]).collect() == []


def write_files(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, lines in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write("".join(line + "\n" for line in lines))


def test_csv_in_byte_ranges_keeps_file_order(spark, scratch):
    files = {f"part-{k:02d}.csv": ["word,n"] + [f"w{i % 7},{k}" for i in range(k * 150)] for k in (3, 0, 1, 12)}
    write_files(f"{scratch}/in", files)
    want = [tuple(line.split(",")) for name in sorted(files) for line in files[name][1:]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = fo.with_file_index(spark, f"{scratch}/in", "csv", schema="word string, n string", options={"multiLine": "false"}, total="all")
        rows = sorted(got.collect(), key=lambda r: r["idx"])
        assert got.columns == ["word", "n", "idx", "all"]
        assert [(r["word"], r["n"]) for r in rows] == want and [r["idx"] for r in rows] == list(range(len(want))) and rows[0]["all"] == len(want)
        kept = fo.with_file_index(spark, f"{scratch}/in", "csv", schema="word string, n string", options={"multiLine": "false"}, keep=F.col("word") != "w3")
        rows = sorted(kept.collect(), key=lambda r: r["idx"])
        assert [(r["word"], r["n"]) for r in rows] == [w for w in want if w[0] != "w3"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_parquet_split_offset_and_many_parts(spark, scratch, monkeypatch):
    for k in (2, 0, 5):
        spark.range(10 * k, 10 * k + 4 + k).selectExpr("id % 3 as v", "'x' as idx_of").coalesce(1).write.parquet(f"{scratch}/t/f={k}")
    want = [i % 3 for k in (0, 2, 5) for i in range(10 * k, 10 * k + 4 + k)]
    for parts in (fo.BROADCAST_PARTS, 0):
        monkeypatch.setattr(fo, "BROADCAST_PARTS", parts)
        rows = sorted(fo.file_order_split(spark, f"{scratch}/t", (0.5, 0.75)).collect(), key=lambda r: r["idx"])
        assert [r["v"] for r in rows] == want
        assert [r["split"] for r in rows] == ["train"] * 9 + ["valid"] * 5 + ["test"] * 5
    assert fo.file_offset_rows(spark, f"{scratch}/t", 15).count() == 4
    spark.range(0).selectExpr("id as v").write.parquet(f"{scratch}/none")
    assert fo.with_file_index(spark, f"{scratch}/none").collect() == []


def test_running_total(spark):
    df = spark.range(1000).selectExpr("cast(id * 37 % 1000 as string) as k", "id % 11 as n")
    rows = sorted(fo.running_total(df, ["k"], "n", "off").collect(), key=lambda r: r["k"])
    total = 0
    for r in rows:
        assert r["off"] == total
        total += r["n"]


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(4000).selectExpr("id", "case when id % 2 = 0 then 'hot' when id % 97 = 0 then null else concat('k', id % 300) end as k", "id % 5 as v")
    right = spark.range(600).selectExpr("id as rid", "case when id % 6 = 0 then 'hot' when id % 50 = 1 then null else concat('k', id % 320) end as k")
    return left, right


def test_skewed_join_equals_the_join(spark, sides):
    left, right = sides
    want = Counter(map(tuple, left.join(right, "k").select("k", "id", "v", "rid").collect()))
    for kw in ({}, {"tasks": 16}, {"tasks": 16, "left_salt": ["id"], "right_salt": ["rid"]}, {"share": 0.9}):
        got = join_skewed(left, right, "k", **kw)
        assert sorted(got.columns) == sorted(left.join(right, "k").columns)
        assert Counter(map(tuple, got.select("k", "id", "v", "rid").collect())) == want
    two = join_skewed(left.withColumn("j", F.col("v") % 2), right.withColumn("j", F.col("rid") % 2), ["k", "j"], tasks=8)
    assert two.count() == left.withColumn("j", F.col("v") % 2).join(right.withColumn("j", F.col("rid") % 2), ["k", "j"]).count()
    assert join_skewed(left.limit(0), right, "k").count() == 0


def test_heavy_keys_are_few_and_found(spark, sides):
    assert set(heavy_keys(sides[0], ["k"], 0.05)) == {("hot",)}
    assert set(heavy_keys(sides[0], ["k"], 0.05, sample_rows=500)) == {("hot",)}


def test_no_task_has_much_more_than_others(spark, sides):
    left, right = sides
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        def largest(df):
            n = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
            return n[-1] / n[len(n) // 2]
        assert largest(left.join(right, "k")) > 10
        assert largest(join_skewed(left, right, "k", left_salt=["id"], right_salt=["rid"])) <= 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
