"""Near-duplicate groups from bottom-k sketches of word shingles.

One hash function; a sketch keeps the k smallest shingle hashes of a document.
Inverted lists of the retained values generate overlaps, the union sketch filters
them, and exact Jaccard on the full shingle sets confirms each link.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import bit_table, hot_keys, in_table, key_filter, row_key, skew_join, stored, test_filter, text_batches

#: Odd multipliers of the shingle hash (any odd 64-bit numbers do).
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A value of more postings than this goes to the end of the order of values.
COMMON = 64


def min_overlap(k: int, similarity: float, miss: float = 1e-9) -> int:
    """Largest t such that two sets of that similarity share fewer than t of the k smallest
    values of their union with probability below ``miss`` (binomial tail)."""
    tail, t = 0.0, 0
    while t < k:
        tail += comb(k, t) * similarity ** t * (1 - similarity) ** (k - t)
        if tail >= miss:
            break
        t += 1
    return max(1, t)


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (fewer words: the whole sequence is one)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    m = min(width, n)
    h = np.full(n - m + 1, np.uint64(m))
    for i in range(m):
        h += w[i:n - m + 1 + i] * np.uint64(_MULT[i % 5] + 2 * (i // 5))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def _sketches(docs: DataFrame, id_col: str, text_col: str, k: int, width: int) -> DataFrame:
    """id, tkey, n_shingles, sig (digest of the whole set), sketch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import blake2b

        for b in batches:
            out = {"n_shingles": [], "sig": [], "sketch": []}
            for t in b["__text"]:
                h = shingle_hashes(t, width)
                out["n_shingles"].append(len(h))
                out["sig"].append(blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                out["sketch"].append(h[:k])
            yield pd.DataFrame({id_col: b["__id"], "tkey": b["tkey"], **out})

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
            .withColumn("tkey", F.xxhash64("__text"))
            .mapInPandas(run, f"`{id_col}` {kind}, tkey long, n_shingles long, sig binary, sketch array<long>"))


def _full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, shingles) of the given class representatives (node, id_col, tkey): the second and last scan of texts."""
    wanted = nodes.select("node", F.col(id_col).alias("own"), F.col("tkey").alias("own_key")).withColumn("rk", row_key("own", "own_key"))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__tkey", F.xxhash64("__text"))
    # The id goes through pandas as a string, which keeps every value and NULL.
    rows = rows.withColumn("__rk", row_key("__id", "__tkey")).withColumn("__id", F.col("__id").cast("string"))
    rows = test_filter(rows, F.col("__rk"), key_filter(wanted, "rk"), "maybe").where("maybe").select("__rk", "__id", "__tkey", "__text")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"__rk": b["__rk"], "__id": b["__id"], "__tkey": b["__tkey"], "shingles": [shingle_hashes(t, width) for t in b["__text"]]})

    same = (F.col("__rk") == F.col("rk")) & F.col("__id").eqNullSafe(F.col("own").cast("string")) & (F.col("__tkey") == F.col("own_key"))
    sets = rows.mapInPandas(run, "__rk long, __id string, __tkey long, shingles array<long>").join(wanted, same)
    # Repeated rows; the join has dealt the rows by the key already.
    return sets.dropDuplicates(["rk", "node"]).select("node", "shingles")


def _index(reps: DataFrame, k: int, similarity: float, t: int) -> DataFrame:
    """Inverted lists (v, node, n) of the values by which any two near-duplicates meet.

    Two sketches of similar documents share at least t values (fewer in small
    sets: 75 % of the set).  Values that only one document retains are left
    out; of the m others of a document, in one global order that puts values of
    many postings last, the first m - t + 1 suffice: two documents that share t
    values share one of these.  So a document without t shared values posts
    nothing, and a passage that many documents share is posted only by documents
    that consist of it.  Both tests use bit tables of constant size and any
    outcome of a collision is the same for all documents, which keeps the rule exact."""
    counts = stored(reps.select(F.explode("sketch").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "values")
    many, common = bit_table(counts, "v", 25), bit_table(counts.where(F.col("n") > COMMON), "v", 20)
    sc = reps.sparkSession.sparkContext
    tables = sc.broadcast((many, common))

    def run(batches):
        many, common = tables.value
        for b in batches:
            v, node, size = [], [], []
            for nd, n, s in zip(b["node"], b["n_shingles"], b["sketch"]):
                s = np.asarray(s, np.int64)
                s = s[in_table(many, s)]
                need = min(t, -int(-n * similarity // 1))
                if len(s) < need:
                    continue
                last = in_table(common, s)
                s = np.concatenate([s[~last], s[last]])[:len(s) - need + 1]
                v.append(s)
                node += [nd] * len(s)
                size += [n] * len(s)
            if v:
                yield pd.DataFrame({"v": np.concatenate(v), "node": node, "n": size})

    return reps.select("node", "n_shingles", "sketch").mapInPandas(run, "v long, node long, n long")


def _caps(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, cap): the size up to which another document can be similar to this one.

    A document can share no more than its shingles that some other one holds too; with s
    of those, n + m may not exceed s (1 + p) / p.  A copy whose edits made too many
    shingles of its own is so known to be alone, without a look at the other copies.  The
    bit table of shared shingles has a fixed size; a collision only raises a cap."""
    counts = sets.select(F.explode("shingles").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    table = sets.sparkSession.sparkContext.broadcast(bit_table(counts, "v", 27))

    def run(batches):
        for b in batches:
            sizes = b["shingles"].map(len).to_numpy(np.int64)
            shared = np.array([in_table(table.value, np.asarray(x, np.int64)).sum() for x in b["shingles"]], np.int64)
            yield pd.DataFrame({"node": b["node"], "n": sizes,
                                "cap": np.minimum(sizes * 100 // percent, shared * (100 + percent) // percent - sizes)})

    return sets.mapInPandas(run, "node long, n long, cap long").where(f"100 * cap >= {percent} * n")


def _confirm(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, k: int, t: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose exact Jaccard similarity reaches ``percent``; the others only cost their sketches."""
    rows = pairs
    for side in ("x", "y"):
        rows = skew_join(rows, sketches.select(F.col("node").alias(side), F.col("n").alias("n" + side), F.col("sketch").alias("s" + side)),
                         side, ["x", "y"], "inner", hot_keys(pairs, side))
    # Union sketch: the smallest values of the two sketches' union; those in both estimate the similarity.
    rows = rows.withColumn("u", F.slice(F.array_sort(F.array_union("sx", "sy")), 1, k)).withColumn(
        "hits", F.size(F.array_intersect("u", F.array_intersect("sx", "sy"))))
    need = F.least(F.lit(t), F.ceil(F.greatest("nx", "ny") * percent / 100.0))
    likely = stored(rows.where(F.col("hits") >= need).select("x", "y", "nx", "ny"), "likely")
    rows = likely
    for side in ("x", "y"):
        rows = skew_join(rows, sets.select(F.col("node").alias(side), F.col("shingles").alias("f" + side)), side, ["x", "y"], "inner",
                         hot_keys(likely, side))
    rows = rows.withColumn("both", F.size(F.array_intersect("fx", "fy")))
    return rows.where(F.col("both") * 100 >= (F.col("nx") + F.col("ny") - F.col("both")) * percent).select("x", "y")


#: Shingles of a block of documents that are compared with another block in one task, about.
BLOCK = 1 << 16


def _compare_blocks(named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents outside the largest component of a list and the other members of such lists.

    Lists are taken together by their largest component.  Its documents and the ones outside
    are each dealt into blocks of bounded size, every block of the outside ones meets
    every block of all, and a task compares two blocks by numpy and returns links only.
    The blocks meet by component and block, so those of one dense group are spread over the tasks."""
    sizes = named.groupBy("main", "node", "label").agg(F.min("n").alias("n"))
    total = sizes.groupBy("main").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("label") != F.col("main"), F.col("n"))).alias("out"))
    dealt = sizes.join(total, "main").join(sets, "node")
    block = lambda c: F.pmod(F.xxhash64("node"), F.ceil(F.col(c) / BLOCK)).alias("block")
    rows = F.collect_list(F.struct("node", "label", "shingles"))
    left = dealt.where("label <> main").groupBy("main", block("out")).agg(rows.alias("xs"), F.first(F.ceil(F.col("all") / BLOCK)).alias("blocks"))
    left = left.select("main", "xs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    right = dealt.groupBy("main", block("all")).agg(rows.alias("ys"))

    def run(batches):
        for b in batches:
            for xs, ys in zip(b["xs"], b["ys"]):
                arrays = [np.asarray(y["shingles"], np.int64) for y in ys]
                size = np.array([len(y) for y in arrays])
                flat, starts = np.concatenate(arrays), np.concatenate([[0], np.cumsum(size)[:-1]])
                node, label = (np.array([y[c] for y in ys]) for c in ("node", "label"))
                for x in xs:
                    own = np.asarray(x["shingles"], np.int64)
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    both = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
                    hit = (100 * both >= percent * (len(own) + size - both)) & (label != x["label"])
                    if hit.any():
                        other = node[hit]
                        yield pd.DataFrame({"x": np.minimum(other, x["node"]), "y": np.maximum(other, x["node"])})

    return left.join(right, ["main", "block"]).select("xs", "ys").mapInPandas(run, "x long, y long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node on an edge (x, y).

    Labels move along edges and then jump to their label's label, so long chains
    take a logarithmic number of rounds; each round is written to the shared folder.
    Rows of hot nodes are salted."""
    both = stored(edges.select("x", "y").union(edges.select(F.col("y"), F.col("x"))).distinct(), "edges")
    hot = hot_keys(both, "x")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    while True:
        seen = skew_join(both, labels.withColumnRenamed("node", "x"), "x", ["y"], "inner", hot)
        step = labels.union(seen.select("y", "label")).groupBy("node").agg(F.min("label").alias("label"))
        step = stored(step, "labels")
        to = step.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        after = stored(skew_join(step, to, "label", ["node"], "left").select("node", F.coalesce("jump", "label").alias("label")), "labels")
        moved = after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        labels = after
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, k: int = 64,
                    rounds: int = 2) -> DataFrame:
    """One row per input row: id_col, tkey, n_shingles, component_id, kept.

    Documents with equal shingle sets form a class; only class representatives go
    on.  Inverted lists are never expanded into pairs: each list links its members
    to a pivot, links are confirmed, and components are formed.  Lists whose members
    are then in one component are done.  In the others, members outside the list's
    largest component try further pivots for some rounds, and what still stands
    apart is finally compared with every member of another component, so no link
    between components is lost.

    NULL and blank texts have an empty set and link with nothing (a component of
    their own); texts of fewer than ``width`` words have one shingle.  Rows
    of NULL id take part; a component of NULL ids only has a NULL component_id.
    Repeated rows share a class and are all reported.  An empty table gives no rows;
    other columns are not read.  kept: the id is the component's."""
    text_batches(docs.sparkSession)
    rounds = max(1, rounds)
    similarity, t = percent / 100, min_overlap(k, percent / 100)
    rows = stored(_sketches(docs, id_col, text_col, k, width).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    empty = rows.where("sig is null").select(id_col, "tkey", "n_shingles", F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    full = rows.where("sig is not null")
    first = full.groupBy("sig").agg(F.min(F.struct("rid", id_col, "tkey")).alias("r"), F.min(id_col).alias("least"))
    names = stored(first.select("sig", F.col("r.rid").alias("node"), "least"), "classes")
    reps = full.join(names.select(F.col("node").alias("rid")), "rid", "left_semi").withColumnRenamed("rid", "node").drop("sig")

    lists = stored(_index(reps, k, similarity, t), "lists")
    sizes = lists.groupBy("v").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    hot_v = hot_keys(lists, "v")
    lists = stored(skew_join(lists, sizes, "v", ["node"], "inner", hot_v).drop("g"), "lists")

    # Only documents that met another one go on: their sketches, and their full sets from one more scan.
    met = stored(reps.join(lists.select("node").distinct(), "node", "left_semi").select("node", id_col, "tkey", "sketch"), "met")
    sets = stored(_full_sets(docs, met, id_col, text_col, width), "sets")
    caps = stored(_caps(sets, percent), "caps")
    sketches = met.join(caps, "node").select("node", "n", "sketch")
    lists = lists.drop("n").join(caps, "node")
    least = lists.groupBy("v").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("g")).where("g > 1")
    lists = stored(skew_join(lists, least, "v", ["node"], "inner", hot_v).where("cap >= least").select("v", "node", "n", "cap"), "lists")
    fits = (F.col("a.n") <= F.col("b.cap")) & (F.col("b.n") <= F.col("a.cap"))

    def central(*by):
        """Order of pivots: those with the fewest shingles of their own first (copies are closest to them), then a hash."""
        return F.struct((-F.floor(20 * F.col("cap") / F.col("n"))).alias("o"), F.xxhash64("node", *by).alias("h"), "node")

    tried, links, labels = None, None, None
    for r in range(rounds + 1):
        named = lists
        if labels is not None:
            named = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            named = stored(named.withColumn("m", F.struct("node", "n", "cap")), "named")
            # Two members are one pair, which round 0 has tried.
            kinds = (named.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("c"))
                     .where("lo <> hi and c > 2").select("v"))
            open_lists = skew_join(named, kinds, "v", ["node"], "inner", hot_v)
            per = open_lists.groupBy("v", "label").agg(F.count(F.lit(1)).alias("c"))
            main = per.groupBy("v").agg(F.max(F.struct("c", "label")).alias("x")).select("v", F.col("x.label").alias("main"))
            named = stored(skew_join(open_lists, main, "v", ["node"], "inner", hot_v), "open")
            lists = named.select("v", "node", "n", "cap")
            if not named.limit(1).count():
                break
        member = F.struct("node", "n", "cap")
        if r == 0:
            # The lists of one dense group mostly have the same pivot, so a document has few pairs.
            pivot = lists.groupBy("v").agg(F.min_by(member, central()).alias("b"))
            pairs = skew_join(lists.select("v", "node", member.alias("a")), pivot, "v", ["node"], "inner", hot_v)
        elif r < rounds:
            # Members outside a list's largest component try one of that component and one of the others, the most central ones.
            order = central(F.col("v"), F.lit(r))
            outside = named.where("label <> main")
            both = named.groupBy("v").agg(F.min_by("m", F.when(F.col("label") == F.col("main"), order)).alias("p"),
                                          F.min_by("m", F.when(F.col("label") != F.col("main"), order)).alias("q"))
            pairs = skew_join(outside.select("v", "node", F.col("m").alias("a")), both, "v", ["node"], "inner", hot_v)
            pairs = pairs.select("a", F.explode(F.array("p", "q")).alias("b"))
        else:
            new = stored(_compare_blocks(named.select("v", "node", "n", "label", "main"), sets, percent), "links")
            links = new if links is None else links.union(new)
            labels = components(links)
            break
        pairs = pairs.where(fits & (F.col("a.node") != F.col("b.node"))).select(
            F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["x", "y"], "left_anti")
        pairs = stored(pairs, "pairs")
        if not pairs.limit(1).count():
            if labels is None:
                labels = components(pairs)
            continue
        tried = pairs if tried is None else tried.union(pairs)
        new = stored(_confirm(pairs, sketches, sets, k, t, percent), "links")
        links = new if links is None else links.union(new)
        labels = components(links)

    named = skew_join(names, labels, "node", ["sig"], "left", [])
    named = stored(named.withColumn("label", F.coalesce("label", "node")), "classes")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = skew_join(named, smallest, "label", ["node"]).select("sig", "component_id")
    out = skew_join(full.select(id_col, "tkey", "n_shingles", "sig", "rid"), classes, "sig", ["rid"])
    return out.select(id_col, "tkey", "n_shingles", "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept")).unionByName(empty)
