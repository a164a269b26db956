from pyspark.sql import functions as F

from lexiflow.operators import bpe
from lexiflow.operators import index as ix
from lexiflow.plans.training import build_batches


def test_batches_per_split(spark):
    rows = [(i, "train" if i < 7 else "valid") for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, split string")
    out = ix.assign_batches(df, 2, seed=3, epoch=1, by="split").collect()
    by = {}
    for r in out:
        by.setdefault((r["split"], r["batch_id"]), []).append(r["row_id"])
    assert sorted(len(v) for k, v in by.items() if k[0] == "train") == [1, 2, 2, 2]
    assert sorted(len(v) for k, v in by.items() if k[0] == "valid") == [1, 2]
    assert all(r["epoch"] == 1 for r in out)
    # another epoch reshuffles, the same epoch reproduces
    again = {r["row_id"]: r["batch_id"] for r in ix.assign_batches(df, 2, seed=3, epoch=1, by="split").collect()}
    assert again == {r["row_id"]: r["batch_id"] for r in out}


def test_build_batches_shapes(spark):
    texts = ["the cat sat on the mat", "a dog ran far away", "the end"]
    model = bpe.learn_bpe(spark.createDataFrame([(t,) for t in texts], "text string"), "text", max_merges=5)
    pairs = spark.createDataFrame([(0, "the cat sat on the mat", "the cat sat on the mat"),
                                   (1, "a dg ran far away", "a dog ran far away"),
                                   (2, "  ", "the end"), (3, "the end", "the end")],
                                  "row_id long, hyp string, ref string")
    clean = build_batches(pairs, model, size=2, noisy=False).collect()
    assert sorted(r["row_id"] for r in clean) == [0, 1, 3]                     # blank pair dropped
    for r in clean:
        assert r["labels"][0] == 5 and 6 in r["labels"]
        assert r["input_pad"] == [x == 3 for x in r["input_ids"]]
        assert r["decoder_input"] == r["labels"][:-1] and r["target"] == r["labels"][1:]
    widths = {}
    for r in clean:
        widths.setdefault(r["batch_id"], set()).add(len(r["labels"]))
    assert all(len(w) == 1 for w in widths.values())                          # padded per batch
    noisy = build_batches(pairs, model, size=2, noisy=True).select("row_id", F.size("input_ids").alias("n")).collect()
    assert len(noisy) == 3


def test_epochs_written_one_after_the_other(spark, scratch):
    from lexiflow.plans.training import write_batches
    model = bpe.learn_bpe(spark.createDataFrame([("the cat sat on the mat",)], "text string"), "text", max_merges=5)
    pairs = spark.createDataFrame([(i, "the cat sat", "the cat sat on", "train" if i < 5 else "valid") for i in range(8)],
                                  "row_id long, hyp string, ref string, split string")
    for epoch in (0, 1, 1):
        write_batches(build_batches(pairs, model, epoch=epoch, by="split", noisy=epoch == 0), f"{scratch}/b")
    got = spark.read.parquet(f"{scratch}/b")
    assert {(r["epoch"], r["n"]) for r in got.groupBy("epoch").agg(F.count("*").alias("n")).collect()} == {(0, 8), (1, 8)}
    assert got.groupBy("epoch", "split", "batch_id").count().where("count > 2").count() == 0


def test_training_batches_equal_plain_version(spark):
    """The gate over the small tables, against plain encoding, noise, order and padding."""
    import hashlib

    from lexiflow.operators.noise import noisy_ids
    from lexiflow.plans.gates import tokenizer as g
    from lexiflow.plans.gates.training import q_training_batches
    from lexiflow.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    m = g._model(spark, SF_SMALL)
    pairs = fx.pairs(spark, SF_SMALL).select("row_id", "hyp", "ref").collect()
    texts = spark.createDataFrame([(r["row_id"], r["hyp"] or "", r["ref"] or "") for r in pairs], "row_id long, h string, r string")
    ids = {r["row_id"]: (r["h"], r["r"]) for r in bpe.encode_columns(texts, ["h", "r"], m, outs=["h", "r"]).collect()}
    rows = [(r["row_id"], [5, *noisy_ids(ids[r["row_id"]][0], 1234, 0, r["row_id"]), 6], [5, *ids[r["row_id"]][1], 6])
            for r in pairs if (r["hyp"] or "").split() and (r["ref"] or "").split()]
    rows.sort(key=lambda r: (hashlib.md5(f"1234|0|{r[0]}".encode()).hexdigest(), r[0]))
    want = {}
    for at in range(0, len(rows), 2):
        part = rows[at:at + 2]
        wi, wl = max(len(r[1]) for r in part), max(len(r[2]) for r in part)
        for pos, (k, i, l) in enumerate(part):
            want[k] = (at // 2, pos, ",".join(map(str, i + [3] * (wi - len(i)))), ",".join(map(str, l + [3] * (wl - len(l)))))
    got = {r["row_id"]: (r["batch_id"], r["batch_pos"], r["input_ids"], r["labels"]) for r in q_training_batches(spark, SF_SMALL).collect()}
    assert got == want
