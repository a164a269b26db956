import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiflow.llm import language_id as li
from lexiflow.llm import quality_model as qm
from lexiflow.llm import secrets as sc
from lexiflow.llm.common import held_out
from lexiflow.llm.mixing import in_mixed_order, mix_sources
from lexiflow.llm.packing import binary_pieces
from lexiflow.llm.queries import QUERIES
from lexiflow.llm.tokens import load_tokenizer, vocab_path
from tests.llm.conftest import SF, frame, rows_of
from tests.llm.conftest import text as words
from tests.llm.test_dedup import brute_components
from tests.llm.test_mixing_rules import counts

BIG = "/root/testdata/sf0.01"


def test_held_out_rule(spark):
    got = {r["i"]: r["h"] for r in spark.range(200).withColumnRenamed("id", "i").select("i", held_out("i").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}


def test_language_accuracy_on_held_out(spark):
    got = QUERIES["op4_language_masks"](spark, BIG).toPandas().merge(pd.read_parquet(f"{BIG}/documents.parquet")[["doc_id", "lang"]])
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    test = got[got["held_out"]]
    assert (test["lang_pred"] == test["lang"]).mean() > 0.98


def test_masks_return_all_languages(spark):
    """The filter never loses a language of an n-gram, whatever their number; counts are corrected for what it adds."""
    rows = [(i * 10 + k, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q shared word{'' if k else 's'}", f"l{i:03d}", "s") for i in range(70) for k in range(3)]
    model = li.learn_filter(frame(spark, rows), min_share=0.5, max_slots=1 << 12)
    assert len(model.names) == 70 and model.table.shape[1] == 2
    for i, name in enumerate(model.names):
        own = li.ngrams(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q shared word")
        masks = model.masks(own)
        assert ((masks[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).all()
        assert model.predict(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q")[0] == name
    assert 0 < model.rates.max() < 1


def test_ngrams_by_hand():
    unpack = lambda g: {"".join(chr(x >> s & 0x1FFFFF) for s in (42, 21, 0)) for x in g.tolist()}
    assert unpack(li.ngrams("Ab, c1É")) == {" ab", "ab ", " c ", " é "}
    assert not len(li.ngrams("12 -- !")) and not len(li.ngrams(""))


def test_language_odd_cases(spark, odd, none):
    model = li.learn_filter(odd)
    got = {(r["doc_id"], r["lang_pred"]) for r in li.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (11, "und"), (None, "und")} <= got
    assert {p for _, p in got} <= {"en", "fr", "und"} and li.identify(odd, model).count() == odd.count()
    blank = li.learn_filter(none)
    assert blank.names == [] and {r["lang_pred"] for r in li.identify(odd, blank).collect()} == {"und"}
    assert li.identify(none, model).count() == 0


def test_quality_on_held_out(spark):
    got = QUERIES["op8_boosted_quality"](spark, BIG).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    test = got[got["held_out"]].merge(pd.read_parquet(f"{BIG}/labels.parquet"))
    assert (test["predicted"] == test["quality"]).mean() > 0.95


def test_flat_trees_equal_recursive_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    f = qm.fit_forest(x, y, trees=20, depth=3)

    def walk(row):
        z = f.base
        for tree in range(len(f.feature)):
            at = 0
            while at < 7:
                at = 2 * at + (2 if row[f.feature[tree, at]] > f.threshold[tree, at] else 1)
            z += f.leaf[tree, at - 7]
        return 1 / (1 + np.exp(-z))

    assert np.allclose(f.scores(x), [walk(r) for r in x]) and ((f.scores(x) > 0.5) == y).mean() > 0.95


def test_quality_odd_cases(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (9, 1, 0), (14, 0, None), (None, 1, 0), (12, None, 1)], "doc_id long, quality int, toxic int")
    got = qm.classify_quality(odd, labels)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in qm.classify_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert qm.classify_quality(none, labels).count() == 0
    assert qm.statistics(None) == qm.statistics("") == [0.0] * len(qm.FEATURES) and len(qm.statistics(" \n")) == len(qm.FEATURES)


ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


@pytest.mark.parametrize("which", ["odd", "sample"])
def test_base_spans(spark, odd, which):
    df = odd if which == "odd" else spark.read.parquet(f"{BIG}/documents.parquet")
    got = sorted(tuple((s["start"], s["kind"], s["end"]) for s in r["base"]) for r in sc.scan_secrets(df).collect())
    assert got == sorted(tuple(plain_base(t)) for t in rows_of(df)["text"])


def test_secret_query_digest(spark):
    got = {r["doc_id"]: r for r in QUERIES["op6_random_secrets"](spark, SF).collect()}
    for d, t in rows_of(spark.read.parquet(f"{SF}/documents.parquet")).itertuples(index=False):
        base = plain_base(t)
        assert got[d]["base_sha256"] == sc.sha256_of(base) and [got[d][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == i for _, k, _ in base) for i in range(3)]
        spans = got[d]["spans"].split(",") if got[d]["spans"] else []
        assert {f"{sc.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(spans)
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), sc.KINDS.index(x.split(":")[0])))


def test_battery_finds_keys_and_leaves_writing(spark):
    """Keys without any keyword, in several encodings, inside prose; long words, paths and runs of one letter."""
    rng = random.Random(7)
    prose = " ".join(r for r in rows_of(spark.read.parquet(f"{SF}/documents.parquet"))["text"])
    rows, keys = [], {}
    for i in range(60):
        name = ("base62", "base64", "base36", "hex")[i % 4]
        key = "".join(rng.choice(sc.ALPHABETS[name]) for _ in range(40 + i % 9))
        keys[i] = key
        rows.append((i, prose[i * 500:i * 500 + 3000] + f" {key} " + prose[i * 900:i * 900 + 500], "en", "s"))
    plain = ["the/path/of/the/readable/words/in/here", "thisisonelongwordmadeofwords", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "____________________________",
             "1234567890123456789012345678901234567890", "abcdefghijklmnopqrstuvwxyzabcdefghijkl", "ThisIsACamelCaseIdentifierOfSomeLength", "=" * 40]
    rows += [(1000 + i, prose[i * 700:i * 700 + 2000] + f" {p} end", "en", "s") for i, p in enumerate(plain)]
    # Ordinary writing enough to measure a small false-discovery rate.
    rows += [(5000 + d, t, "en", "s") for d, t in rows_of(spark.read.parquet(f"{BIG}/documents.parquet")).itertuples(index=False)]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"] if s["kind"] == 3] for r in sc.scan_secrets(frame(spark, rows)).collect()}
    hit = sum(any(rows[i][1][s:e].strip("=") == k.strip("=") or k in rows[i][1][s:e] for s, e in got[i]) for i, k in keys.items())
    assert hit >= 50, hit
    assert [rows[60 + i][1][s:e] for i in range(len(plain)) for s, e in got[1000 + i]] == []


def test_single_keys_in_small_and_foreign_tables(spark):
    """One key is found in a small table, in one without Latin letters, and next to any number of rules and paths."""
    rng = random.Random(11)
    small = [t for t in rows_of(spark.read.parquet(f"{SF}/documents.parquet"))["text"]]
    foreign = ["\u0434\u043b\u0438\u043d\u043d\u044b\u0439 \u0442\u0435\u043a\u0441\u0442 " * 30] * 40
    rules = ["-" * 20 + "\n" + "=" * 40 + "\n" + "_-" * 15 + "\nthe/path/of/the/readable/words/in/here\n"] * 400
    for texts in (small, foreign, small + rules):
        for name in ("base62", "base64"):
            key = "".join(rng.choice(sc.ALPHABETS[name]) for _ in range(40))
            rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(9999, f"see {key} here", "en", "s")]
            got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["found"] if x["kind"] == 3] for r in sc.scan_secrets(frame(spark, rows)).collect()}
            assert got[9999] == [(4, 44)], (name, got[9999])
            assert not any(got[i] for i in range(len(small) if texts is not foreign else 0, len(texts)))
    assert sc.candidates("-" * 30 + " " + "a" * 30 + " " + "=-_/" * 8) == []


def test_keys_next_to_names_paths_and_separators(spark):
    """Keys after NAME=, in URLs and connection strings, glued to paths and to other separators; offsets are the key's."""
    rng = random.Random(5)
    draw = lambda name, n: "".join(rng.choice(sc.ALPHABETS[name]) for _ in range(n))
    mixed = lambda name, extra: draw(name, 20) + extra + draw(name, 20) + extra + draw(name, 20)
    b62, b64, url = draw("base62", 40), mixed("base64", "+/"), mixed("base64url", "-_")
    lines = [("export AUTH_KEY=", b62, " # set"), ("https://host.example/a/b?sig=", b62, "&x=1"), ("AccountName=x;AccountKey=", b64 + "==", ";End"),
             ("see usr/local-share/my_dir/", b62, "/more_of it"), ("id_", b64, " end"), ("some/path+to/", url, " end"), ("a=b=", b62, "=c d")]
    rows = [(i, f"some words {a}{k}{z}", "en", "s") for i, (a, k, z) in enumerate(lines)]
    rows += [(5000 + d, t, "en", "s") for d, t in rows_of(spark.read.parquet(f"{SF}/documents.parquet")).itertuples(index=False)]
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["found"] if x["kind"] == 3] for r in sc.scan_secrets(frame(spark, rows)).collect()}
    for i, (a, k, z) in enumerate(lines):
        at = len("some words " + a)
        assert got[i] == [(at, at + len(k))], (i, a, [rows[i][1][s:e] for s, e in got[i]])
    assert sc.parts("NAME=" + "ab1" * 8 + "==") == [(5, 31)] and sc.parts("ab1" * 8 + "=x") == [(0, 24)]


def test_background_takes_all_letters():
    t = "x1y " * 320
    got = sc.background([t, "", "\u0434" * 100]).reshape(6, 3, -1).sum(axis=2).tolist()
    assert got == [[640 // 24, 16, 10]] * 4 + [[1279 // 24, 1279 // 40, 1279 // 64]] * 2  # the last two with a separator between words


def test_p_values_of_random_strings_are_spread():
    rng = np.random.default_rng(1)
    for name in sc.ENCODINGS:
        p = sc.randomness(rng.integers(0, len(sc.ALPHABETS[name]), (4000, 40)), len(sc.ALPHABETS[name]))
        assert (p < 0.01).mean() < 0.05 and 0.3 < p.mean() < 0.7


def plain_p(codes, size, digits):
    """The battery letter by letter, in floats."""
    from math import erfc, exp, log, sqrt

    n, groups = len(codes), int(min(size, max(2, len(codes) // 5)))
    upper = lambda z: erfc(z / sqrt(2)) / 2
    of = [c * groups // size for c in range(size)]
    chi = sum((sum(of[c] == g for c in codes) - n * of.count(g) / size) ** 2 / (n * of.count(g) / size) for g in range(groups))
    df = groups - 1
    p_chi = upper(((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / sqrt(2 / (9 * df)))
    high = [c >= size // 2 for c in codes]
    up = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * up * (n - up) / n + 1
    p_runs = 2 * upper(abs(runs - mean) / sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))) if 0 < up < n else 1e-12
    m = sum(codes) / n
    lag = sum((a - m) * (b - m) for a, b in zip(codes, codes[1:])) / max(1e-9, sum((c - m) ** 2 for c in codes))
    p_lag = 2 * upper(abs(lag) * sqrt(n - 1))
    share, k = sum(digits) / size, sum(bool(digits[c]) for c in codes)
    binom = [math.comb(n, j) * share ** j * (1 - share) ** (n - j) for j in range(n + 1)]
    p_digit = min(1.0, 2 * min(sum(binom[:k + 1]), sum(binom[k:])))
    half = -sum(log(max(p, 1e-12)) for p in (p_chi, p_runs, p_lag, p_digit))
    return exp(-half) * sum(half ** j / math.factorial(j) for j in range(4))


def test_battery_equals_a_plain_version():
    rng = random.Random(3)
    words = [w for t in rows_of_sample(40) for w in re.findall("[A-Za-z]{20,}", t.replace(" ", ""))]
    for name, alphabet in sc.ALPHABETS.items():
        keys = ["".join(rng.choice(alphabet) for _ in range(rng.choice([20, 24, 33, 64, 90]))) for _ in range(25)] + [alphabet[0] * 30, alphabet[:20]]
        keys += [w[:60] for w in words if set(w[:60]) <= set(alphabet)][:15] + [("ab" * 200)[:300] if name != "base32" else "AB" * 150]
        for k in keys:
            codes = [alphabet.index(c) for c in k]
            want = plain_p(codes, len(alphabet), sc.DIGITS[name])
            assert sc.randomness(np.array([codes]), len(alphabet), sc.DIGITS[name])[0] == pytest.approx(want, rel=2e-3, abs=1e-9), (name, k)
    assert all(x.isdigit() == bool(d) for name, a in sc.ALPHABETS.items() for x, d in zip(a, sc.DIGITS[name]))


def rows_of_sample(n):
    return [t for t in pd.read_parquet(f"{SF}/documents.parquet").text[:n] if t]


def test_background_equals_a_plain_version():
    texts = rows_of_sample(12) + ["", "  ", "a", "x/y--z " * 60, "\u00e9t\u00e9 " * 200]
    want = np.zeros((len(sc.ENCODINGS) * len(sc.LENGTHS), sc.BINS), int)
    for t in texts:
        for e, name in enumerate(sc.ENCODINGS):
            between = sc.BETWEEN.get(name, "")
            run = re.sub("[^A-Za-z]+", between, t).strip(between or None)
            run = run.upper() if name == "base32" else run.lower() if name == "base36" else run
            codes = [(ord(c.lower()) - 97) * 10 // 26 if name == "hex" else sc.ALPHABETS[name].index(c) for c in run]
            for i, (_, n) in enumerate(sc.LENGTHS):
                for at in range(0, len(codes) - n + 1, n):
                    p = sc.randomness(np.array([codes[at:at + n]]), len(sc.ALPHABETS[name]), sc.DIGITS[name])
                    want[e * len(sc.LENGTHS) + i, int(sc._bin(p)[0])] += 1
    assert (sc.background(texts) == want).all()


def test_cuts_and_choice_equal_a_plain_version():
    rng = np.random.default_rng(4)
    ordinary = rng.integers(0, 2000, (18, sc.BINS)) * (np.arange(sc.BINS) < 30)
    found = rng.integers(0, 3, (18, sc.BINS)) * (rng.random((18, sc.BINS)) < 0.2)
    p = sc.p_values(ordinary)
    for cell, cut in enumerate(sc.cuts(found, ordinary, 0.001)):
        mine = sorted((p[cell, b], -b) for b in range(sc.BINS) for _ in range(found[cell, b]))
        passed = [-b for i, (x, b) in enumerate(mine) if x <= 0.001 * sum(q <= (x, b) for q in mine) / len(mine)]
        least = min(passed, default=sc.BINS)
        chosen = lambda cut: [b for b in range(cut, sc.BINS) if found[cell, b]]
        assert chosen(cut) == chosen(least), (cell, cut, least)


def test_long_keys_are_found_before_whole_text_background():
    """Keys of 32 and more characters of every encoding, each alone, against the letters of a table."""
    texts = [t or "" for t in pd.read_parquet(f"{BIG}/documents.parquet").text]
    p, rng = sc.p_values(sum(sc.background(texts[i:i + 200]) for i in range(0, len(texts), 200))), random.Random(1)
    for name, alphabet in sc.ALPHABETS.items():
        for n in (32, 40, 64):
            keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(200)]
            hits = sum(any(p[c[2], c[3]] <= 0.001 for c in sc.candidates(f" {k} ")) for k in keys)
            assert hits >= 180, (name, n, hits)


def test_empty_secret_table(none):
    assert sc.scan_secrets(none).count() == 0


def plain_pipeline(docs):
    """All stages over (doc_id, text, source) rows, without Spark; pieces per document (host verdicts come from all rules)."""
    t = docs[["doc_id", "text", "source"]].copy()
    c = pd.DataFrame([counts(x) for x in t["text"]], columns=["w", "wc", "sym", "dup", "rep"], index=t.index)
    lines = t["text"].map(lambda x: sum(bool(l.strip(" \t\x0b\x0c\r")) for l in x.split("\n")))
    base = (c["w"] < 50) | (100 * c["rep"] > 50 * c["w"])
    failed = base | (100 * c["sym"] > 50 * c["w"]) | (100 * c["dup"] > 30 * lines)
    per = failed.groupby(t["source"]).agg(["sum", "size"])
    # Beta prior: mean of all rows, strength from what the rates vary beyond chance; a host is judged by the rate it exceeds at 95 %.
    n, all_, m = per["size"], per["size"].sum(), per["sum"].sum() / per["size"].sum()
    beyond = (n * (per["sum"] / n - m) ** 2).sum() / (m * (1 - m)) - (len(per) - 1)
    k = 1 / max(1 / 1001, min(1 / 3, beyond / (all_ - (n ** 2).sum() / all_ - (len(per) - 1)))) - 1
    p = (per["sum"] + m * k) / (n + k)
    host = t["source"].map(p - 1.645 * (p * (1 - p) / (n + k + 1)) ** 0.5)
    t = t[~base & ~(host > 0.75) & ~((host > min(0.25, 1.5 * m)) & failed)]
    t = t.loc[t.groupby("text")["doc_id"].idxmax()]
    comp = {d: x for d, _, x in brute_components(t["doc_id"].tolist(), t["text"].tolist())}
    t = t[[comp[d] == d for d in t["doc_id"]]]
    tok = load_tokenizer(vocab_path("byte_bpe_50k.json"))
    out = []
    for d, x in zip(t["doc_id"], t["text"]):
        raw = np.array(tok.encode(x, add_special_tokens=False).ids + [0], "<u4")
        out += [(d, a, n, zlib.crc32(raw[a:a + n].tobytes()), len(raw)) for a, n in binary_pieces(len(raw), 1024)]
    return sorted(out)


def test_pipeline_equals_plain_version(spark, docs):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()) == plain_pipeline(docs)


def test_quality_stage_judges_each_row(spark):
    """Clean repeated rows all stay; of rows equal in id and text the one of the rejected host goes, the other stays."""
    good, junk = [words(i, 60) for i in range(40)], [" ".join(w + "###" for w in words(i, 60).split()) for i in range(40)]
    rows = [(i, good[i], None, "clean") for i in range(30)] + [(100 + i, junk[i], None, "bad") for i in range(30)]
    rows += [(7, good[7], None, "clean"), (7, good[7], None, "bad"), (8, good[8], None, None), (None, good[9], None, "clean"), (None, good[9], None, "clean"),
             (None, good[9], None, "bad")]
    got = corpus_pipeline.apply_quality_rules(spark, frame(spark, rows), SF).select("doc_id", "text", "source").collect()
    want = [(i, t, src) for i, t, _, src in rows if src != "bad"]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_sequences_follow_the_mix(spark, scratch):
    """Over many files of different sizes, read in several splits, the ids of each bucket follow (slot, start) of the mix."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    docs = docs.withColumn("text", F.expr("repeat(text, if(doc_id % 9 = 0, 12, 1))"))  # some of several longest pieces
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = mix_sources(docs, block_chars=4000)
        in_mixed_order(docs, placed).write.option("maxRecordsPerFile", 90).parquet(f"{scratch}/mix")
        mixed = spark.read.parquet(f"{scratch}/mix")
        assert len(mixed.inputFiles()) > 8 and mixed.rdd.getNumPartitions() > 2
        got = corpus_pipeline.pack(spark, mixed, BIG).toPandas()
        again = corpus_pipeline.pack(spark, mixed, BIG).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got["sequence_id"].is_unique and (got["sequence_id"] // 2 ** 58 == got["bucket"]).all()
    key = ["bucket", "sequence_id"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    got = got.merge(placed.select("doc_id", "slot", F.col("start").alias("at")).toPandas(), on="doc_id")
    by_id = got.sort_values("sequence_id")[["doc_id", "start"]].to_numpy()
    by_mix = got.sort_values(["bucket", "slot", "at", "start"])[["doc_id", "start"]].to_numpy()
    assert (by_id == by_mix).all()


def test_stages_on_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, none):
            out = stage(spark, df, SF)
            n = out.count()
            assert n >= 0 if df is odd else n == 0
            if name != "pack_binary":
                assert out.columns == df.columns
            if name == "mix_sources":
                assert n == df.count()
    assert hashlib.sha256(b"").hexdigest() == sc.sha256_of([])


def test_languages_equal_an_exact_scorer(spark):
    """The bit-sliced filter decides like exact sets of the same trigrams: equal predictions, scores apart by false positives only."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    learn = docs[docs["lang"].notna() & docs["text"].notna()]
    model = li.learn_filter(spark.read.parquet(f"{SF}/documents.parquet"))
    sets = {}
    for lang, part in learn.groupby("lang"):
        n = {}
        for t in part["text"]:
            for g in set(li.ngrams(t).tolist()):
                n[g] = n.get(g, 0) + 1
        sets[lang] = {g for g, c in n.items() if c >= 0.01 * len(part)}
    assert model.names == sorted(sets)
    for i, name in enumerate(model.names):
        mine = np.array(sorted(sets[name]))
        assert ((model.masks(mine)[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).all()  # never one too few
    for t in docs["text"].tolist() + ["", "12 -- 3", "a", "zq xj"]:
        grams = li.ngrams(t or "").tolist()
        got, score = model.predict(t)
        if not grams:
            assert (got, score) == ("und", 0.0)
            continue
        hits = [sum(g in sets[name] for g in grams) for name in model.names]
        best, rest = sorted(hits)[-1], sorted(hits)[-2]
        if best - rest > 0.03 * len(grams) + 1:
            assert got == model.names[hits.index(best)] and abs(score - best / (best + rest)) < 0.05


def test_first_split_equals_a_plain_search():
    """The root of a one-level tree: best gain over every feature and every edge, searched row by row."""
    rng = np.random.default_rng(8)
    for _ in range(5):
        x = rng.integers(0, 12, (60, 4)).astype(np.float32)
        y = ((x[:, 2] > 5) ^ (rng.random(60) < 0.2)).astype(float)
        forest = qm.fit_forest(x, y, trees=1, depth=1, bins=64)
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        g, h = p - y, np.full(60, p * (1 - p))
        best = (0.0, None)
        for f in range(4):
            for edge in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])):
                left = x[:, f] <= edge
                hl, hr = h[left].sum(), h[~left].sum()
                if hl < 1 or hr < 1:
                    continue
                gain = g[left].sum() ** 2 / (hl + 1) + g[~left].sum() ** 2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, left))
        f, left = best[1]
        assert forest.feature[0][0] == f and ((x[:, f] <= forest.threshold[0][0]) == left).all()
        values = [-0.2 * g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)]
        assert forest.leaf[0] == pytest.approx(values)


def test_labelled_rows_are_cut_by_hash(spark):
    stats = spark.range(3000).selectExpr("id as doc_id", f"array_repeat(cast(id % 7 as float), {len(qm.FEATURES)}) as x")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 7 > 3 as int) as quality")
    plan = []
    real = qm.fit_forest
    try:
        qm.fit_forest = lambda x, y, **k: plan.append(len(y)) or real(x, y, **k)
        qm.fit_quality(stats.unionByName(stats), labels, max_rows=500)
        qm.fit_quality(stats, labels, max_rows=5000)
        qm.fit_quality(stats.limit(0), labels)
    finally:
        qm.fit_forest = real
    assert plan == [500, 3000, 0]
