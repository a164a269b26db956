import hashlib

import pandas as pd
import pytest

from lexiflow.llm.common import hot_keys, keep_rows, skew_join
from lexiflow.llm.exact_dedup import dedup_exact
from lexiflow.llm.near_dedup import components, min_overlap, near_duplicates
from tests.llm.conftest import SF, frame, text


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = [x for x in lower(t).translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(ids, texts):
    """Component per row by comparing all pairs; rows of an equal text link."""
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(zip(ids, sets))]


def key(r):
    return tuple((x is not None, x) for x in r)


def table(df, *cols):
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in df.select(*cols).toPandas().astype(object).itertuples(index=False)), key=key)


def ids_texts(df):
    return zip(*[(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("which", ["odd", "sample"])
def test_exact_equals_grouping(spark, odd, which):
    df = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    best = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
    want = sorted(((d, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows), key=key)
    got = dedup_exact(df, digest_all=True)
    assert table(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = [r["text_sha256"] for r in got.where("kept").collect()]
    assert len(kept) == len(set(kept)) == len(groups)
    assert got.where("kept and not (doc_id <=> keep_id)").count() == 0


def test_full_hash_only_of_survivors(spark):
    df = frame(spark, [(1, "abc", None, None), (2, "abd", None, None), (3, "abc", None, None), (4, "longer", None, None)])
    got = {r["doc_id"]: r["text_sha256"] for r in dedup_exact(df).collect()}
    assert got[1] and got[3] and got[2] is None and got[4] is None


@pytest.mark.parametrize("which", ["odd", "sample"])
def test_near_equals_all_pairs(spark, odd, which):
    df = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = near_duplicates(df)
    want = brute_components(*ids_texts(df))
    assert table(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=key)
    assert got.where("kept <> (doc_id <=> component_id)").count() == 0


def edited(base, seed, share):
    w = base.split()
    for j in range(int(len(w) * share)):
        w[(seed * 131 + j * 37) % len(w)] = f"edit{seed}x{j}"
    return " ".join(w)


def test_near_dense_group_of_unequal_copies(spark):
    """Copies of one text around the threshold: pivots link some, the rounds and the last pass the others."""
    base = text(9, 300)
    rows = [(i, edited(base, i, 0.008 + 0.004 * (i % 6)), None, "a") for i in range(70)]
    rows += [(200 + i, text(40 + i, 60) + " " + text(9, 90), None, "a") for i in range(25)]  # a shared passage only
    df = frame(spark, rows)
    for rounds in (1, 3):
        assert table(near_duplicates(df, rounds=rounds), "doc_id", "n_shingles", "component_id") == sorted(brute_components(*ids_texts(df)), key=key)


def test_chains_make_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 102)], "x long, y long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 102, 103: 102}


def test_empty_tables(none):
    assert dedup_exact(none).count() == 0 and near_duplicates(none).count() == 0


def test_min_overlap_is_in_the_tail():
    assert min_overlap(64, 0.75) == 25 and min_overlap(1, 0.75) == 1


def test_skew_join_equals_join(spark):
    rows = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) as k")
    side = spark.range(60).selectExpr("id as k", "id * 2 as v")
    hot = hot_keys(rows, "k", 0.2)
    assert hot == [7]
    a, b = skew_join(rows, side, "k", ["id"], "left", hot), rows.join(side, "k", "left")
    assert sorted(map(tuple, a.select("id", "k", "v").collect())) == sorted(map(tuple, b.select("id", "k", "v").collect()))


def test_rows_that_share_a_hash_are_told_apart(spark, odd, monkeypatch):
    """Every row key equal: both dedup stages of the pipeline still keep the right rows."""
    from pyspark.sql import functions as F

    from lexiflow.llm import common, near_dedup

    want_exact = table(keep_rows(odd, dedup_exact(odd)), "doc_id", "text", "source")
    want_sets = table(near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    want_near = table(keep_rows(odd, near_duplicates(odd)), "doc_id", "text")
    for module in (common, near_dedup):
        monkeypatch.setattr(module, "row_key", lambda *c: F.lit(5).cast("long"))
    assert table(keep_rows(odd, dedup_exact(odd)), "doc_id", "text", "source") == want_exact
    assert table(near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept") == want_sets
    assert table(keep_rows(odd, near_duplicates(odd)), "doc_id", "text") == want_near


def test_keep_rows_drops_and_keeps_columns(spark, odd):
    got = keep_rows(odd, dedup_exact(odd))
    assert got.columns == odd.columns
    texts = [r["text"] or "" for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in odd.collect()})
