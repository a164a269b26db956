"""Line dedup, hard negatives and whitening against plain versions."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import hard_negatives as hn
from lexiflow.llm import line_dedup as ld
from lexiflow.llm import whitening as wh

from .conftest import SF, frame, rows_of, text

# -- line dedup ---------------------------------------------------------------


def plain_lines(rows):
    """doc_id, n_lines, n_dropped, kept text of each (doc_id, text)."""
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: (i is not None, i or 0)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(held[key(x)]) < 2 or min(held[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def as_set(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()), key=repr)


LINES = ["A shared heading here", "  a SHARED heading here\t", "short", "ÄÖ shared in two texts", "äÖ shared in two texts", "", "one of a kind in a text"]


@pytest.fixture(scope="module")
def lined(spark):
    rows = [(i, "\n".join(LINES[(i * 7 + j * 3) % len(LINES)] + ("" if j % 3 else f" {i % 5}") for j in range(1 + i % 9)), "en", "a") for i in range(60)]
    rows += [(70, None, None, None), (71, "", "en", "a"), (None, "a shared heading here\nlast line of all", "en", "a"), (None, "last line of all", "en", "a"),
             (72, "twice in one text\ntwice in one text", "en", "a"), (73, "of one document only\nx", "en", "a"), (73, "of one document only", "en", "b"),
             (74, "\n\n\n", "en", "a"), (75, "\n".join(["a shared heading here"] * 5000 + [text(1, 50)]), "en", "a"), (76, "a shared heading here\r\n\x0bEND of the line\x0c", "en", "a")]
    return frame(spark, rows + rows[:3])


def test_lines_equal_a_plain_version(spark, lined, odd, none):
    for docs in (lined, odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert as_set(ld.dedup_lines(docs)) == sorted(plain_lines(rows), key=repr)
    assert ld.dedup_lines(none).collect() == []


def test_index_takes_documents_in_and_out(spark, lined, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", (2, 4))
    docs = lined.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    part = lambda c: docs.where(c)

    def state(index):
        shards = {r["shard"]: np.frombuffer(bytes(r["slots"]), np.uint16).reshape(-1, ld.SLOTS) for r in index.filters.collect()}
        counts = {(r["k1"], r["k2"]): (r["n"], r["first"]) for r in index.counts.collect()}
        for (k1, k2), (n, _) in counts.items():
            if n > 1:
                assert ld.filter_contains(shards[k1 % index.shards], np.array([k2])).all()
        assert sum(int((t > 0).sum()) for t in shards.values()) == sum(n > 1 for n, _ in counts.values())
        return counts, sorted(tuple(r) for r in index.postings.collect())

    empty = ld.empty_index(spark)
    low = ld.insert_documents(empty, part("doc_id >= 30"))
    both = ld.insert_documents(low, part("doc_id < 30"))
    whole = ld.insert_documents(empty, docs)
    assert state(both) == state(whole)
    again = ld.insert_documents(both, part("doc_id in (3, 40)"))  # already held
    assert state(again) == state(whole)
    back = ld.delete_documents(both, part("doc_id < 30").select("doc_id").union(spark.createDataFrame([(999,)], "doc_id long")))
    assert state(back) == state(low)
    rows = [(r["doc_id"], r["text"]) for r in part("doc_id >= 30").collect()]
    assert as_set(ld.drop_repeated_lines(part("doc_id >= 30"), back)) == sorted(plain_lines(rows), key=repr)
    gone = ld.delete_documents(whole, docs.select("doc_id"))
    assert state(gone) == ({}, [])
    # A later document against the index: its lines go if an earlier one holds them.
    later = frame(spark, [(900, "a shared heading here\nnever seen before", "en", "a")])
    more = ld.insert_documents(whole, later)
    assert [(r["n_dropped"], r["kept_text"]) for r in ld.drop_repeated_lines(later, more).collect()] == [(1, "never seen before")]


def test_lines_without_the_filters(lined, monkeypatch):
    want = as_set(ld.dedup_lines(lined))
    monkeypatch.setattr(ld, "FILTER_BYTES", 0)
    assert as_set(ld.dedup_lines(lined)) == want


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-2 ** 63, 2 ** 63, 20_000)
    table = ld.filter_of(keys)
    assert ld.filter_contains(table, keys).all()
    assert ld.filter_contains(table, rng.integers(-2 ** 63, 2 ** 63, 100_000)).mean() < 0.001
    ld.filter_delete(table, keys[:15_000])
    assert ld.filter_contains(table, keys[15_000:]).all() and (table > 0).sum() == 5_000
    assert ld.filter_contains(table, keys[:15_000]).mean() < 0.001
    assert ld.filter_insert(table, keys[:15_000]) and ld.filter_contains(table, keys).all()
    ld.filter_delete(table, keys)
    assert not table.any()
    # Keys of one print and bucket: as many as the slots hold, and out one by one.
    same = np.full(2 * ld.SLOTS, keys[0])
    table = np.zeros((64, ld.SLOTS), np.uint16)
    assert ld.filter_insert(table, same) and not ld.filter_insert(table.copy(), same[:1])
    ld.filter_delete(table, same[:-1])
    assert (table > 0).sum() == 1 and ld.filter_contains(table, same[:1]).all()


def test_line_query_on_a_table(spark):
    from lexiflow.llm.queries import QUERIES

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_lines(list(zip(docs.doc_id, docs.text)))}
    got = QUERIES["op11_line_dedup"](spark, SF).collect()
    assert {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got} == want and len(got) == len(docs)


# -- hard negatives -----------------------------------------------------------

def vectors(spark, rows):
    """embeddings-like table with extra columns whose names clash with results and helpers."""
    schema = "vec_id long, embedding array<float>, label int, id long, x string, w int, found long, score double, block int, chunk int, cell int, n int, index int, component string"
    return spark.createDataFrame([(i, v, y, 1, "x", 2, 3, 0.5, 4, 5, 6, 7, 8, "c") for i, v, y in rows], schema)


def plain_mining(rows, is_anchor, k=5, low=80, scale=256):
    ok = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(scale * float(np.float32(c))) for c in v]
        if i not in ok or (str(y), x) < (str(ok[i][0]), ok[i][1]):
            ok[i] = (y, x)
    out = set()
    for a, (y, x) in ok.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, z)), i, u) for i, (u, z) in ok.items() if i != a)
        for s, p, _ in [t for t in scored if t[2] == y][:k]:
            inside = [(t, i) for t, i, u in scored if u != y and low * -s <= 100 * -t <= 100 * -s][:k]
            out |= {(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(inside)}
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 10))
    rows = [(i, (centres[i % 12] + 0.15 * rng.normal(size=10)).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(900)]
    rows += [(2000 + i, rows[5][1], i % 3) for i in range(150)]  # one vector, many times
    return rows


def odd_vectors():
    inf, nan = float("inf"), float("nan")
    return [(None, [1.0, 2.0], 1), (200, None, 1), (300, [1.0, None], 1), (400, [inf, 1.0], 1), (500, [nan, 1.0], 2), (600, [1.0, 2.0], None),
            (700, [0.5, 0.25], 1), (700, [0.5, 0.25], 1), (700, [0.75, 0.25], 1), (800, [1.0], 1), (801, [], 2), (802, [0.5, 0.5], 2), (900, [-1.0, -1.0], 1),
            (901, [-0.5, -1.0], 1), (902, [1e9, 3.0], 2), (903, [0.0, 0.0], 1), (1000, [0.0, 0.0], 3), (1001, [0.4, 0.1], 3)]


def test_negatives_equal_a_plain_version(spark, clustered):
    for rows in (clustered, odd_vectors(), clustered + odd_vectors()[:8]):
        got = hn.mine_hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0)
        cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        got = [tuple(r) for r in got.select(*cols).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_mining(rows, lambda i: i % 100 == 0)
    none = vectors(spark, [])
    assert hn.mine_hard_negatives(none, F.col("vec_id") % 100 == 0).collect() == []
    assert hn.mine_hard_negatives(vectors(spark, clustered), F.lit(False)).collect() == []


def test_search_stops_early_and_splits_blocks(spark, clustered, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", (16, 32))
    monkeypatch.setattr(hn, "SEARCHES", 3)
    monkeypatch.setattr(hn, "CELL_ROWS", 8)
    visited, real = [], hn._requests

    def counting(searches, index, budget):
        out = real(searches, index, budget)
        visited.append((index, [(r["id"], c) for r in out.select("id", "cells", "block").collect() for c in r["cells"]]))
        return out

    monkeypatch.setattr(hn, "_requests", counting)
    df = vectors(spark, clustered)
    got = {tuple(r) for r in hn.mine_hard_negatives(df, F.col("vec_id") % 100 == 0).collect()}
    assert got == plain_mining(clustered, lambda i: i % 100 == 0)
    index = visited[0][0]
    assert index.blocks.count() >= 30 and max(index.cells["blocks"]) > 1
    pairs = [p for _, v in visited[:3] for p in set(v)]
    assert len(pairs) == len(set(pairs))  # no cell twice in one search
    rows = sum(index.cells["n"][c] for _, c in pairs)
    assert rows < 0.5 * 11 * len(clustered)  # 11 anchors: far from all rows


def test_requests_come_in_bounded_batches(spark, clustered, monkeypatch):
    """A task hands requests on as it makes them, whatever the number of searches in its input batch."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", (16, 32))
    monkeypatch.setattr(hn, "CELL_ROWS", 8)
    monkeypatch.setattr(hn, "REQUESTS", 64)
    rows = hn.integer_vectors(vectors(spark, clustered), 256.0, "vec_id", "embedding", "label")
    index = hn.build_index(rows)
    searches = rows.select("id", "label", "x", F.array(F.lit(hn._FAR)).alias("hi"), F.array(F.lit(-hn._FAR)).alias("lo"), F.lit(0).alias("popped"))
    held = {}

    class Frame:  # takes the place of the table: the task's function is called here
        def mapInPandas(self, run, schema):
            held["run"] = run

    hn._requests(Frame(), index, float("inf"))
    sizes = [len(b) for b in held["run"](iter([searches.toPandas()]))]
    blocks = index.blocks.count()
    assert sum(sizes) > 2000 and max(sizes) < 64 + blocks


def test_packed_integers_are_exact():
    for x in ([1, -32768], [1 << 40, -3], [-(1 << 63), (1 << 63) - 1], [(1 << 53) + 1, 0]):
        m = np.array([x], np.int64)
        assert hn._unpacked(hn._packed(m), 2).tolist() == m.tolist()


def test_multi_sequence_is_sorted():
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=17), rng.normal(size=9).round(1)
    seen = list(hn.multi_sequence(u, v))
    assert len({(i, j) for _, i, j in seen}) == 17 * 9
    assert all(s == pytest.approx(u[i] + v[j]) for s, i, j in seen)
    assert all(a[0] >= b[0] - 1e-12 for a, b in zip(seen, seen[1:]))


# -- whitening ----------------------------------------------------------------

def plain_white(rows, k=16):
    ok = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in ok)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in ok], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    off = (fit - s / n)
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > values[0] * 1e-10).sum()))
    return [i for i, _ in ok], n, ((n * x - s) ** 2).sum(1), (x - s / n) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_white(got, rows):
    ids, n, deviation, white, explained = plain_white(rows)
    k = white.shape[1]
    assert len(got) == len(ids) * k and set(got["component"]) == set(range(1, k + 1)) and (got["n"] == n).all()
    assert (got["identity_error"] < 1e-8).all() and got["identity_error"].nunique() == 1
    got = got[got["vec_id"].notna()].sort_values(["vec_id", "component", "deviation"])
    mine = np.array([v for i, v in sorted(((i, tuple(r)) for i, r in zip(ids, np.column_stack([deviation, white])) if i is not None), key=lambda p: (p[0], p[1][0]))])
    by = got.groupby("component")
    for c, part in by:
        part = part.sort_values(["vec_id", "deviation"])
        assert part["deviation"].tolist() == mine[:, 0].astype(int).tolist()
        w, m = part["whitened"].to_numpy(), mine[:, c]
        assert np.abs(w - np.sign(w @ m) * m).max() < 1e-6
        assert part["explained"].iloc[0] == pytest.approx(explained[c - 1], rel=1e-9)


def test_whitening_equals_a_plain_version(spark, clustered):
    for rows in (clustered, clustered + [(None, clustered[0][1], 1), (None, clustered[1][1], 1), (5, clustered[2][1], 1)] + odd_vectors()[1:6],
                 [(1, [0.5, 0.1, 2.0], 1), (2, [0.5, 0.3, -2.0], 1), (3, [0.5, 0.9], 1), (4, [0.5, 0.1, 2.0], 1)]):
        check_white(wh.whiten(vectors(spark, rows)).toPandas(), rows)


def test_whitening_without_directions(spark):
    for rows in ([], [(1, None, 1)], [(1, [0.5, 0.25], 1)], [(1, [0.5], 1), (2, [0.5], 2)], [(1, [], 1), (2, [], 2)]):
        out = wh.whiten(vectors(spark, rows))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_in_several_blocks(spark, monkeypatch, clustered):
    monkeypatch.setattr(wh, "BLOCK_ROWS", (64, 64))
    check_white(wh.whiten(vectors(spark, clustered).repartition(5)).toPandas(), clustered)


def test_far_entries_keep_their_deviation(spark):
    rows = [(1, [1e8, 0.0], 1), (2, [-1e8, 0.5], 1), (3, [0.0, 1.0], 1), (4, [3e15, 2.0], 1)]
    got = wh.whiten(vectors(spark, rows)).where("component = 1").collect()
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, _ in rows]
    x = [[max(-2 ** 52, min(2 ** 52, a - 1_000_000)) + 1_000_000 for a in v] for v in x]
    s = [sum(c) for c in zip(*x)]
    for r in got:
        d = sum((4 * a - b) ** 2 for a, b in zip(x[r["vec_id"] - 1], s))
        assert r["deviation"] == (d if d < 2 ** 63 else None)


def test_odd_tables_have_the_columns(none, odd, spark):
    out = ld.dedup_lines(odd)
    assert out.columns == ["doc_id", "tkey", "n_lines", "n_dropped", "kept_text"] and out.count() == len(rows_of(odd))
