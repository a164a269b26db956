from pyspark.sql import functions as F

from lexiflow.functions import arrays as A
from lexiflow.operators import noise


def _ids(spark, rows):
    return spark.createDataFrame(rows, "row_id long, ids array<int>")


def test_noise_counts_and_lengths(spark):
    rows = [(i, list(range(10, 10 + n))) for i, n in enumerate([1, 2, 16, 17, 50, 351])]
    df = _ids(spark, rows)
    out = df.select("row_id", F.size("ids").alias("L"),
                    noise.insert("ids", 1, 0, "row_id").alias("ins"),
                    noise.substitute("ids", 1, 0, "row_id").alias("sub"),
                    noise.corrupt("ids", 1, 0, "row_id").alias("mix")).collect()
    for r in out:
        n = int(0.06 * r["L"])
        assert len(r["ins"]) == r["L"] + n                 # insertion grows by n
        assert len(r["sub"]) == r["L"]                     # substitution keeps the length
        assert len(r["mix"]) == r["L"] + n + 2             # plus BOS/EOS
        assert r["mix"][0] == 5 and r["mix"][-1] == 6
        assert r["sub"][0] == 10                           # position 0 never changes
        if r["L"] < 17:
            assert n == 0 and r["ins"] == list(range(10, 10 + r["L"]))


def test_substitution_last_draw_wins(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "ids array<int>")
    draws = F.array(F.struct(F.lit(2).alias("pos"), F.lit(70).alias("val")),
                    F.struct(F.lit(2).alias("pos"), F.lit(80).alias("val")))
    out = df.select(F.transform("ids", lambda x, i: F.coalesce(
        F.try_element_at(F.filter(draws, lambda d: d["pos"] == i), F.lit(-1))["val"], x)).alias("o")).first()["o"]
    assert out == [1, 2, 80, 4]


def test_insert_at_and_positions(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<int>")
    r = df.select(A.insert_at("ids", 1, 9).alias("a"), A.insert_at("ids", 2, 9).alias("b")).first()
    assert r["a"] == [1, 9, 2, 3] and r["b"] == [1, 2, 9, 3]


def test_noise_partition_invariant(spark):
    rows = [(i, list(range(100 + i))) for i in range(40)]
    base = _ids(spark, rows)
    digests = set()
    for n in (1, 4, 17):
        d = base.repartition(n).select(F.md5(A.ids_text(noise.corrupt("ids", 7, 2, "row_id"))).alias("h"))
        digests.add(tuple(sorted(r["h"] for r in d.collect())))
    assert len(digests) == 1


def test_pad_mask_strip_shift(spark):
    df = spark.createDataFrame([([5, 3, 8, 6, 3, 3],)], "ids array<int>")
    r = df.select(A.pad_mask("ids").alias("m"), A.strip_pad("ids").alias("s"),
                  A.shift_pairs("ids").alias("sh"), A.strip_bos_eos("ids").alias("st")).first()
    assert r["m"] == [False, True, False, False, True, True]   # an injected 3 is masked too
    assert r["s"] == [5, 8, 6]
    assert r["sh"]["decoder_input"] == [5, 3, 8, 6, 3] and r["sh"]["target"] == [3, 8, 6, 3, 3]
    assert r["st"] == [3, 8, 6, 3, 3]                          # last id is not EOS: kept


def test_strip_with_eos_and_short(spark):
    df = spark.createDataFrame([([5, 7, 6],), ([5],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(A.strip_bos_eos("ids")).collect()] == [[7], [], []]


def test_argmax_and_ctc(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0],)], "v array<double>")
    assert [r[0] for r in df.select(A.argmax("v")).collect()] == [1, 0]     # tie -> first
    fr = spark.createDataFrame([([[0.9, 0.1], [0.9, 0.1]],), ([[0.1, 0.9], [0.9, 0.1], [0.1, 0.9], [0.1, 0.9]],)],
                               "f array<array<double>>")
    assert [r[0] for r in fr.select(A.ctc_collapse("f")).collect()] == [[], [1, 1]]


def test_one_hot_and_cross_entropy(spark):
    import math
    df = spark.createDataFrame([(2, [1.0, 2.0, 3.0])], "c int, v array<double>")
    r = df.select(A.one_hot("c", 4).alias("o"), A.cross_entropy("v", "c").alias("ce")).first()
    assert r["o"] == [0, 0, 1, 0]
    expect = -math.log(math.exp(3) / (math.exp(1) + math.exp(2) + math.exp(3)))
    assert abs(r["ce"] - expect) < 1e-12


def test_position_vector(spark):
    import math
    r = spark.range(1).select(A.position_vector(F.lit(3), 4).alias("p")).first()["p"]
    div = [math.exp(k * -math.log(10000.0) / 4) for k in (0, 2)]
    assert [round(x, 12) for x in r] == [round(x, 12) for x in
                                         [math.sin(3 * div[0]), math.cos(3 * div[0]), math.sin(3 * div[1]), math.cos(3 * div[1])]]


def test_draws_equal_the_column_draws(spark):
    from lexiflow.functions import rng
    df = spark.range(200).select("id", rng.uniform(9, F.lit(3), F.col("id"), "sub_pos", F.lit(4)).alias("u"),
                                 rng.randint(6, 19000, 9, F.lit(3), F.col("id"), "ins_val", F.lit(0)).alias("k"))
    for r in df.collect():
        assert r["u"] == noise._uniform(9, 3, r["id"], "sub_pos", 4)
        assert r["k"] == noise._between(6, 19000, 9, 3, r["id"], "ins_val", 0)


def test_null_ids_stay_null(spark):
    df = _ids(spark, [(1, None), (2, []), (3, [7])])
    assert [tuple(r) for r in df.select(noise.corrupt("ids", 1, 0, "row_id"), noise.substitute("ids", 1, 0, "row_id")).collect()] == [
        (None, None), ([5, 6], []), ([5, 7, 6], [7])]
