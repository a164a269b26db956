import re
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import quality_rules as q
from lexiflow.llm.mixing import deal, in_mixed_order, mix_sources
from tests.llm.conftest import SF, frame, rows_of, text


def test_windows_and_deviation(spark):
    """Every block runs inside its window, each slot holds one block, and no source is a block off its share."""
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', 99) as text", "case when id % 3 = 0 then 'hot' when id % 7 = 1 then null else concat('s', id % 5) end as source")
    weights = {"hot": 5.0, None: 1.0, "s0": 2.5, "s1": 2.5, "s2": 1.0, "s3": 1.0, "s4": 0.3}
    got = mix_sources(docs, weights, block_chars=300, period=40)
    assert got.count() == 4000 and got.select("doc_id").distinct().count() == 4000
    blocks = got.select("source", "block", "slot", "release", "deadline", "stretch").distinct().toPandas()
    assert blocks["slot"].is_unique and (blocks["release"] <= blocks["slot"]).all() and (blocks["slot"] < blocks["deadline"]).all()
    first = blocks[blocks["stretch"] == blocks["stretch"].min()].sort_values("slot")
    n, shares = len(first), first.groupby("source", dropna=False).size()
    assert n % 40 == 0
    for s, c in shares.items():
        mine = first["source"].isna() if s != s else first["source"] == s
        ahead = mine.cumsum().to_numpy() - (first["slot"].to_numpy() + 1) * c / n
        assert abs(ahead).max() < 1, (s, abs(ahead).max())


def test_mix_is_whole_and_repeatable(spark, odd):
    a, b = (sorted(map(str, mix_sources(df, block_chars=2000, period=8).collect())) for df in (odd, odd.repartition(7)))
    assert a == b and len(a) == odd.count()
    order = in_mixed_order(odd, mix_sources(odd, block_chars=2000, period=8))
    assert order.columns == odd.columns and sorted(map(str, order.collect())) == sorted(map(str, odd.collect()))


def plain_schedule(blocks, weights):
    """Slot by slot from the definition: flows as fractions, windows searched, earliest deadline of the released."""
    names = sorted(blocks, key=lambda s: (s is not None, s))
    w = {s: Fraction(weights[s]) for s in names}
    total = sum(blocks.values())
    flows, flow = [dict.fromkeys(names, Fraction(0))], dict.fromkeys(names, Fraction(0))
    for _ in range(total):
        step = Fraction(1)
        while step:
            live = [s for s in names if flow[s] < blocks[s]]
            if not live:
                break
            all_w = sum(w[s] for s in live)
            part = min([step, *[(blocks[s] - flow[s]) * all_w / w[s] for s in live]])
            for s in live:
                flow[s] += part * w[s] / all_w
            step -= part
        flows.append(dict(flow))
    # Block k: released in the last slot boundary at which k blocks had not flowed past, due once k + 1 have.
    window = {s: [(max(t for t in range(total + 1) if flows[t][s] <= k), min(t for t in range(total + 1) if flows[t][s] >= k + 1)) for k in range(blocks[s])] for s in names}
    done, out = dict.fromkeys(names, 0), []
    for slot in range(total):
        ready = [(window[s][done[s]][1], i, s) for i, s in enumerate(names) if done[s] < blocks[s] and window[s][done[s]][0] <= slot]
        due, _, s = min(ready)
        out.append((s, done[s], slot, window[s][done[s]][0], due))
        done[s] += 1
    return out


@pytest.mark.parametrize("case", [({"a": 7, "b": 3, None: 2}, {"a": 0.5, "b": 0.3, None: 0.2}), ({"x": 1}, {"x": 3.0}),
                                  ({f"s{i}": 1 + i * 5 % 9 for i in range(12)}, {f"s{i}": 0.1 + i * 7 % 5 for i in range(12)}),
                                  ({"big": 40, **{f"t{i}": 1 for i in range(15)}}, {"big": 1.0, **{f"t{i}": 1 / 3 for i in range(15)}})])
def test_dealt_slots_equal_a_plain_schedule(case):
    assert [t[:5] for t in deal(*case)] == plain_schedule(*case)


def test_blocks_are_bounded(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', 9) as text", "concat('s', id % 4) as source")
    got = mix_sources(docs, {"s0": 3.0, "s1": 1.0, "s2": 1.0, "s3": 1.0}, block_chars=1, max_blocks=100)
    assert got.count() == 3000 and got.agg(F.max("slot")).first()[0] < 104
    assert got.groupBy("source", "block").count().agg(F.max("count")).first()[0] <= 31  # 300 characters


def test_one_rule_at_every_size(spark):
    """Neither the number of sources nor that of blocks changes the rule."""
    docs = spark.range(5000).selectExpr("id as doc_id", "repeat('x', 9) as text", "concat('s', id) as source")
    got = mix_sources(docs)
    assert got.where("block = 0 and slot >= release and slot < deadline").select("slot").distinct().count() == 5000
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', 99) as text", "concat('s', id % 2) as source")
    got = mix_sources(docs, {"s0": 1.0, "s1": 1.0}, block_chars=1)
    assert got.where("block = start").count() == 3000 and got.agg(F.max("start")).first()[0] >= 149_000


def test_many_small_sources_share_lanes(spark):
    """Far more sources than are dealt on their own: all rows placed, large sources in their windows, small ones spread like the rest."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 9) as text", """case when id % 2 = 0 then 'large' when id % 10 = 1 then null
        else concat('host', cast(id as string)) end as source""")
    got = mix_sources(docs, block_chars=200, max_sources=50).cache()
    assert got.count() == 20_000 and got.select("doc_id").distinct().count() == 20_000
    assert (got.where("slot < release or slot >= deadline").count(), got.where("source like 'host%' or source is null").count()) == (0, 10_000)
    slots = got.groupBy("slot").agg(F.count_distinct(F.when(~F.col("source").startswith("host"), F.col("source"))).alias("own"), F.count(F.lit(1)).alias("n"))
    assert slots.where("own > 1").count() == 0 and slots.count() == got.agg(F.max("slot")).first()[0] + 1
    large = got.where("source = 'large'").select("block", "slot").distinct().orderBy("slot").toPandas()
    assert (large["block"] == range(500)).all()


def test_ten_thousand_sources_and_ten_million_blocks():
    """The driver's share of a table of ten million blocks of 64k characters: it deals max_blocks larger ones."""
    chars = {f"s{i:05d}": 65_536 * (210 + i * 17 % 1600) for i in range(10_000)}
    block = -(-sum(chars.values()) // (1 << 18))
    assert sum(chars.values()) // 65_536 >= 10_000_000
    began, slots = time.time(), 0
    for slots, (_, _, slot, release, due, _) in enumerate(deal({s: -(-c // block) for s, c in chars.items()}, {s: c ** 0.5 for s, c in chars.items()}), 1):
        assert release <= slot < due
    assert slots <= (1 << 18) + 10_000 and time.time() - began < 60


def counts(t):
    t = t or ""
    spaces = "[ \t\n\x0b\x0c\r]"
    words = [w for w in re.split(spaces + "+", t) if w]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(3)}
    lines = [x for x in t.split("\n") if re.sub(spaces, "", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))


@pytest.mark.parametrize("which", ["odd", "sample"])
def test_rule_counts_equal_plain_python(spark, odd, which):
    df = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    df = df.union(df.limit(1).withColumn("text", F.lit("a b c a b c a b c a\n\x0bf f f\x0c \r f f\na b c"))) if which == "odd" else df
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted(tuple(r) for r in q.quality_rules(df).select(cols).collect())
    assert got == sorted(counts(t) for t in rows_of(df)["text"])


def test_host_verdicts_shrink_and_reach_documents(spark):
    good, junk = [text(i, 60) for i in range(40)], [" ".join(w + "###" for w in text(i, 60).split()) for i in range(40)]
    rows = [(i, good[i], None, "clean") for i in range(30)] + [(100 + i, junk[i], None, "bad") for i in range(30)]
    rows += [(200 + i, (junk if i < 12 else good)[i], None, "mixed") for i in range(24)] + [(300, junk[39], None, "tiny"), (400, junk[38], None, None)]
    got = q.quality_rules(frame(spark, rows))
    verdict = {r["host"]: r["verdict"] for r in got.select("host", "verdict").distinct().collect()}
    assert verdict["clean"] == "pass" and verdict["bad"] == "reject" and verdict["mixed"] == "strict" and verdict[None] == "pass"
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert all(kept[i] for i in range(30)) and not any(kept[100 + i] for i in range(30))
    assert [kept[200 + i] for i in range(24)] == [False] * 12 + [True] * 12 and kept[400]
    rates = {r["host"]: (r["rate"], r["shrunk"]) for r in q.host_verdicts(got.select("host", F.col("rule_failed").cast("int").alias("failed"))).collect()}
    assert rates["tiny"][1] < rates["tiny"][0] == 1.0


def test_verdicts_equal_plain_python(spark):
    """Hosts that differ, hosts that differ by chance only, and a host alone; small hosts need more failures to be sure of."""
    import random

    rnd = random.Random(3)
    differ = {f"h{i}": [int(rnd.random() < (0.9 if i % 7 == 0 else 0.05)) for _ in range(5 + 40 * (i % 4))] for i in range(30)}
    differ["small"] = [1]
    alike = {f"h{i}": [int(rnd.random() < 0.15) for _ in range(50)] for i in range(20)}
    for hosts in (differ, alike, {"one": [0, 1, 1]}, {"a": [0] * 9, "b": [0] * 4}, {"a": [1] * 200, "b": [1]}):
        big, fail = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
        m, per = fail / big, {h: (len(v), sum(v)) for h, v in hosts.items()}
        part = big - sum(n * n for n, _ in per.values()) / big - (len(per) - 1)
        share = (sum(n * (f / n - m) ** 2 for n, f in per.values()) / (m * (1 - m)) - (len(per) - 1)) / part if 0 < m < 1 and part else 0.0
        k = 1 / max(1 / 1001, min(1 / 3, share)) - 1
        rows = [(h, x) for h, v in hosts.items() for x in v] + [(None, 1)] * 5
        got = {r["host"]: r for r in q.host_verdicts(spark.createDataFrame(rows, "host string, failed int")).collect()}
        assert set(got) == set(hosts)
        for h, (n, f) in per.items():
            p = (f + m * k) / (n + k)
            sure = p - 1.645 * np.sqrt(p * (1 - p) / (n + k + 1))
            assert got[h]["shrunk"] == pytest.approx(p) and got[h]["sure"] == pytest.approx(sure)
            assert got[h]["verdict"] == ("reject" if sure > 0.75 else "strict" if sure > min(0.25, 1.5 * m) and sure > 0 else "pass")
        if hosts is alike:
            assert k == pytest.approx(1000) and all(r["verdict"] == "pass" for r in got.values())
        if hosts is differ:
            assert got["h7"]["verdict"] != "pass" and got["small"]["verdict"] == "pass" and got["h1"]["verdict"] == "pass"


def test_a_bad_host_changes_documents_of_a_table(spark):
    """One host of the table gets symbols in half of its documents: it alone is judged, and loses just those."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoilt = (F.col("source") == "src3") & (F.col("doc_id") % 2 == 0)
    docs = docs.unionByName(spark.range(1000, 1060).select(F.col("id").alias("doc_id"), F.lit(text(4, 90)).alias("text"), F.lit("en").alias("lang"), F.lit("src3").alias("source"), F.lit(1).cast("long").alias("n_chars")))
    docs = docs.withColumn("text", F.when(spoilt & (F.col("doc_id") >= 1000), F.concat("text", F.lit(" " + "#" * 120))).otherwise(F.col("text")))
    got = q.quality_rules(docs)
    assert {r["host"] for r in got.where("verdict <> 'pass'").select("host").distinct().collect()} == {"src3"}
    changed = got.where("not kept and not base_failed").collect()
    assert {r["doc_id"] for r in changed} >= set(range(1000, 1060, 2)) and all(r["host"] == "src3" and r["rule_failed"] for r in changed)
    assert got.where("doc_id >= 1000 and doc_id % 2 = 1 and not kept").count() == 0


def test_native_plans(spark, odd):
    for df in (q.quality_rules(odd), mix_sources(odd)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables(none):
    assert mix_sources(none).count() == 0 and q.quality_rules(none).count() == 0


@pytest.mark.parametrize("n", [20, 130, 600])
def test_deviation_from_the_given_weights(spark, n):
    """After every slot each source is less than a block from the weights of the sources that are left, with any number of sources."""
    weights = {"big": 0.5, **{f"s{i:03d}": 0.5 * (1 + i % 3) / (2 * n) for i in range(n)}}
    blocks = {s: (3000 if s == "big" else 5 + i % 17) for i, s in enumerate(weights)}
    docs = spark.createDataFrame([(s, c) for s, c in blocks.items()], "source string, c int").selectExpr(
        "source", "explode(sequence(1, c)) as i").selectExpr("xxhash64(source, i) as doc_id", "repeat('x', 99) as text", "source")
    got = mix_sources(docs, weights, block_chars=100).toPandas().sort_values("slot")
    assert (got["slot"] == range(sum(blocks.values()))).all()
    assert (got["release"] <= got["slot"]).all() and (got["slot"] < got["deadline"]).all()
    names = list(weights)
    w, left = np.array([weights[s] for s in names]), np.array([blocks[s] for s in names], float)
    flow, done, index = np.zeros(len(names)), np.zeros(len(names)), {s: i for i, s in enumerate(names)}
    for s in got["source"]:
        step = 1.0
        while step > 1e-12:  # the ideal mix, cut where a source ends
            live = left - flow > 1e-9
            if not live.any():
                break
            rate = np.where(live, w, 0) / w[live].sum()
            part = min(step, ((left - flow)[live] / rate[live]).min())
            flow, step = flow + part * rate, step - part
        done[index[s]] += 1
        assert abs(done - flow).max() < 1 + 1e-6
