"""Byte-pair-encoding vocabulary: learning, encoding and decoding on Spark.

Learning works on the table of distinct pre-tokens with their counts (one row
per distinct word, not per occurrence).  Merges are inherently sequential: a full
vocabulary takes some thousand rounds, each of which depends on all before it.
So they are learned in windows: a Spark job counts adjacent symbol pairs weighted by word
count (a group-by with map-side partial sums), another cuts the words to the distinct runs of
pairs with counts above a floor, which tell every merge of a count above it; one task learns
these from that table (of a checked size, ``LOCAL_SYMBOLS``) with incremental pair counts, and a
last job applies them to all words.  Where no such table fits, a round takes one merge, with a
reliable checkpoint every few rounds.  Both ways give the same merges.

Encoding is a function of the row alone: the merge table is bounded by the
vocabulary size, so it travels with the function and nothing is shuffled.

Symbols are integers during learning: a character is its code point, the k-th
learned token is 2**21 + k.  Ordering by these integers is the same as ordering
by final vocabulary ids (specials, then the alphabet by code point, then merges
in creation order), which is the tie-break of the merge selection: highest
count, then lowest left id, then lowest right id.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions._util import col_of, let
from lexiflow.functions.arrays import SPECIAL_TOKENS, UNK
from lexiflow.functions.text import pretokenize
from lexiflow.session import ensure_checkpoint_dir, text_batches

#: Symbols of a window's table, which one task learns from, at most (some hundred bytes each in that task).
LOCAL_SYMBOLS = 2_000_000
#: Pairs whose counts a window is cut from, at most, and the share of the highest count that its floor starts at.
WINDOW_PAIRS = 20_000
WINDOW_RATIO = 16
MERGED_BASE = 1 << 21
_PAIR_SHIFT = 1 << 22


@dataclass
class BPEModel:
    """Vocabulary (id -> token) and ranked merges; small by construction
    (bounded by ``vocab_size``), so it lives on the driver and ships as a
    literal or a broadcast."""

    tokens: list[str]
    merges: list[tuple[str, str, str]]
    specials: list[str] = field(default_factory=lambda: list(SPECIAL_TOKENS))

    @property
    def token_to_id(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, t in enumerate(self.tokens):
            out.setdefault(t, i)
        return out

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, i < len(self.specials)) for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, "id int, token string, special boolean")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k, l, r, m) for k, (l, r, m) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, l string, r string, merged string")


# --------------------------------------------------------------- counting ----
def word_counts(df: DataFrame, c: str = "text") -> DataFrame:
    """words(word, n): pre-token frequency table."""
    return (df.select(F.explode(pretokenize(c)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def _tables(batches, values: int = 1 << 18):
    """(n, symbols of all words one after the other, symbols per word) of Arrow batches (n, syms), about ``values`` symbols at a time."""
    held, size = [], 0

    def table():
        t = pa.Table.from_batches(held).combine_chunks()
        syms = t["syms"].combine_chunks() if t["syms"].num_chunks != 1 else t["syms"].chunk(0)
        return (t["n"].to_numpy().astype(np.int64), syms.flatten().to_numpy().astype(np.int64),
                syms.value_lengths().to_numpy().astype(np.int64))

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += len(b.column("syms").flatten())
        if size >= values:
            yield table()
            held, size = [], 0
    if held:
        yield table()


def _arrow_words(n, flat, lens) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum(lens))).astype(np.int32)
    syms = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), syms], ["n", "syms"])


def _word_ids(lens):
    return np.repeat(np.arange(len(lens)), lens)


def _sums(keys, weights):
    """(distinct keys in order, sum of the weights of each), exact in 64 bits."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def initial_symbols(words: DataFrame) -> DataFrame:
    """(n, syms ARRAY<INT>): each word as the code points of its characters."""
    def run(batches):
        for b in batches:
            found = b.column("word").to_pylist()
            lens = np.fromiter((len(w or "") for w in found), np.int64, len(found))
            flat = np.frombuffer("".join(w or "" for w in found).encode("utf-32-le"), np.uint32)
            syms = _arrow_words(b.column("n"), flat, lens).column("syms")
            if b.column("word").null_count:
                syms = pc.if_else(b.column("word").is_valid(), syms, pa.scalar(None, syms.type))
            yield pa.RecordBatch.from_arrays([b.column("n"), syms], ["n", "syms"])
    return words.select(F.col("n").cast("bigint").alias("n"), "word").mapInArrow(run, "n long, syms array<int>")


def pair_counts(state: DataFrame) -> DataFrame:
    """(l, r, count): adjacent symbol pairs weighted by word count."""
    def run(batches):
        for n, flat, lens in _tables(batches):
            word = _word_ids(lens)
            inner = np.flatnonzero(word[1:] == word[:-1])
            p, count = _sums(flat[inner] * _PAIR_SHIFT + flat[inner + 1], n[word[inner]])
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(count, pa.int64())], ["p", "n"])
    return (state.where(F.size("syms") >= 2).select("n", "syms").mapInArrow(run, "p long, n long")
            .groupBy("p").agg(F.sum("n").alias("count"))
            .select(F.shiftright("p", _PAIR_SHIFT.bit_length() - 1).alias("l"), F.pmod(F.col("p"), F.lit(_PAIR_SHIFT)).alias("r"), "count"))


def apply_merge(syms: Column, left: int, right: int, new: int) -> Column:
    """Merge non-overlapping occurrences of (left, right) from left to right."""
    return F.aggregate(
        syms, F.array().cast("array<int>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == F.lit(left)) & (x == F.lit(right)),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(new))))
        .otherwise(F.concat(acc, F.array(x))))


def _merge_step(left: int, right: int, new: int):
    """Lambda body for one merge: words without both symbols pass unchanged."""
    def step(s_):
        return F.when(F.array_contains(s_, left) & F.array_contains(s_, right),
                      apply_merge(s_, left, right, new)).otherwise(s_)
    return step


def _accept_batch(top, bounds, tokens_left: int, limit: int) -> list:
    """Merges of one round that provably equal the next merges of one-at-a-time
    learning.  ``top`` is the pair ranking of this round; a candidate is taken
    while (1) it shares no symbol with the pairs taken before it, so its count
    is unchanged by them, and (2) its count is strictly above every count a
    newly created pair can reach: a pair (z, ab) needs an occurrence of
    (z, a), a pair (ab, z) one of (b, z), so max count(z, a) and max count(b, z)
    over all z bound them."""
    taken, used, bound = [], set(), 0
    for row in top:
        l, r, n = int(row["l"]), int(row["r"]), int(row["count"])
        if taken and (l in used or r in used or n <= bound):
            break
        taken.append((l, r))
        used.update((l, r))
        bound = max(bound, bounds.get(("into", l), 0), bounds.get(("from", r), 0))
        if len(taken) >= min(limit, tokens_left):
            break
    return taken


def _alternate(hit, follows):
    """Of equal symbols in a row, from left to right, the hits that do not overlap; ``follows``: a hit begins inside the one before."""
    at = np.arange(len(hit))
    began = np.maximum.accumulate(np.where(follows, 0, at))
    return hit & ((at - began) % 2 == 0)


def _merge_rounds(n, flat, lens, floor: int, limit: int, most: int | None, learned: dict[int, str], known: set, first: int) -> list[tuple[int, int, int]]:
    """Merges (left, right, new symbol) over words and their counts while a pair has a count above ``floor``, up to
    ``limit`` tokens that are not ``known`` and ``most`` merges; ``first`` merges went before and made ``learned``.

    A pair stands at its left symbol's place; links lead to the symbols before and after.  Pair counts and places are kept up to
    date around each merge; the next pair is the one of highest count, then lowest left id, then lowest right id."""
    import heapq

    learned, known = dict(learned), set(known)
    ids = {t: s for s, t in learned.items()}
    none = len(flat)  # the place of a missing neighbour
    word = _word_ids(lens)
    syms, weight = np.append(flat, -1), n[word]
    after, before = np.arange(1, none + 2), np.arange(-1, none)
    ends = np.flatnonzero(word[1:] != word[:-1])
    after[ends], before[ends + 1] = none, none
    after[none - 1:], before[:1], before[none] = none, none, none
    counts: dict[int, int] = {}
    where: dict[int, list] = {}
    heap: list = []

    def pairs_at(places):
        places = places[after[places] != none]
        return places, syms[places] * _PAIR_SHIFT + syms[after[places]]

    def stand(places, pairs):
        order = np.argsort(pairs, kind="stable")
        places, pairs = places[order], pairs[order]
        cuts = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
        for pair, a, b in zip(pairs[np.append(0, cuts)].tolist() if len(pairs) else (), [0, *cuts.tolist()], [*cuts.tolist(), len(pairs)]):
            where.setdefault(pair, []).append(places[a:b])

    def count(pairs, change):
        for pair, more in zip(*(x.tolist() for x in _sums(pairs, change))):
            if more:
                counts[pair] = now = counts.get(pair, 0) + more
                heapq.heappush(heap, (-now, pair))

    places, pairs = pairs_at(np.arange(none))
    stand(places, pairs)
    count(pairs, weight[places])
    merges, fresh = [], 0
    while heap and fresh < limit and (most is None or len(merges) < most):
        n_, pair = heapq.heappop(heap)
        if -n_ <= floor:
            break
        if counts[pair] != -n_:
            continue
        left, right = divmod(pair, _PAIR_SHIFT)
        merged = "".join(learned[x] if x in learned else chr(x) for x in (left, right))
        new = ids.setdefault(merged, MERGED_BASE + first + len(merges))
        learned[new] = merged
        merges.append((left, right, new))
        if merged not in known:
            known.add(merged)
            fresh += 1
        at = np.concatenate(where.pop(pair))
        at = at[(syms[at] == left) & (syms[after[at]] == right)]  # the others have been merged since
        if left == right:
            at = np.sort(at)
            at = at[_alternate(np.ones(len(at), bool), np.append(False, after[at[:-1]] == at[1:]))]
        gone = after[at]
        old, old_pairs = pairs_at(np.setdiff1d(np.concatenate((before[at], at, gone)), [none]))
        syms[at], syms[gone] = new, -1
        after[at] = after[gone]
        before[after[at]] = at
        before[none] = none
        now, now_pairs = pairs_at(np.setdiff1d(np.concatenate((before[at], at)), [none]))
        stand(now, now_pairs)
        count(np.concatenate((old_pairs, now_pairs)), np.concatenate((-weight[old], weight[now])))
    return merges


def _replay_table(n, flat, lens, steps: dict):
    """(n, flat, lens) of the words after the merges ``steps`` {pair: [(place in the order, new symbol), ...]}, one after the
    other, each from left to right (what ``apply_merge`` does for one); yields words as they are done, in no order.

    All words go on at once, each by the merge that is its next one."""
    listed = sorted((left * _PAIR_SHIFT + right, k, new) for (left, right), ks in steps.items() for k, new in ks)
    pairs = np.array(sorted({p for p, _, _ in listed}), np.int64)
    last = 1 + max((k for _, k, _ in listed), default=0)  # no merge
    if not listed or (len(pairs) + 1) * (last + 2) >= 1 << 62:
        raise ValueError("no merges, or too many for one pass")
    keys = np.searchsorted(pairs, np.array([p for p, _, _ in listed], np.int64)) * (last + 1) + np.array([k for _, k, _ in listed])
    made = np.full(last + 1, -1, np.int64)
    for _, k, new in listed:
        made[k] = new

    def next_merge(left, right, since):
        """Place of the first merge of a pair after the merge ``since``."""
        p = left * _PAIR_SHIFT + right
        i = np.minimum(np.searchsorted(pairs, p), len(pairs) - 1)
        at = np.minimum(np.searchsorted(keys, i * (last + 1) + since + 1), len(keys) - 1)
        k = keys[at] - i * (last + 1)
        return np.where((pairs[i] == p) & (k > since) & (k < last), k, last)

    word = _word_ids(lens)
    due = np.full(len(flat), last, np.int64)
    inner = np.flatnonzero(word[1:] == word[:-1])
    due[inner] = next_merge(flat[inner], flat[inner + 1], np.int64(-1))
    if not lens.all():
        yield n[lens == 0], flat[:0], lens[lens == 0]
        n, lens = n[lens > 0], lens[lens > 0]
    while len(lens):
        starts = np.cumsum(lens) - lens
        turn = np.minimum.reduceat(due, starts)
        open_ = turn < last
        if not open_.all():
            of = np.repeat(open_, lens)
            yield n[~open_], flat[~of], lens[~open_]
            n, lens, turn, flat, due = n[open_], lens[open_], turn[open_], flat[of], due[of]
            if not len(lens):
                break
            starts = np.cumsum(lens) - lens
        hit = due == np.repeat(turn, lens)
        follows = np.append(False, hit[1:] & hit[:-1])
        if follows.any():
            hit = _alternate(hit, follows)
        at = np.flatnonzero(hit)
        flat[at] = made[due[at]]
        keep = np.ones(len(flat), bool)
        keep[at + 1] = False
        lens = lens - np.add.reduceat(hit, starts, dtype=np.int64)
        flat, due = flat[keep], due[keep]
        at -= np.arange(len(at))
        word = _word_ids(lens)
        look = np.concatenate((at, at[at > 0] - 1))
        due[at] = last
        look = look[look + 1 < len(flat)]
        look = look[word[look] == word[look + 1]]
        due[look] = next_merge(flat[look], flat[look + 1], turn[word[look]])


def _replay(syms: list[int], steps: dict) -> list[int]:
    """``_replay_table`` for one word."""
    flat = np.array(syms, np.int64)
    return next(f.tolist() for _, f, w in _replay_table(np.ones(1, np.int64), flat, np.array([len(syms)], np.int64), steps) if len(w))


def apply_merges(state: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(n, syms) after many merges (left, right, new) in their order; words of one symbol left go."""
    steps: dict = {}
    for k, (left, right, new) in enumerate(merges):
        steps.setdefault((left, right), []).append((k, new))

    def run(batches):
        for table in _tables(batches):
            for n, flat, lens in _replay_table(*table, steps):
                of = np.repeat(lens >= 2, lens)
                yield _arrow_words(n[lens >= 2], flat[of], lens[lens >= 2])
    return state.select("n", "syms").mapInArrow(run, "n long, syms array<int>")


def frequent_runs(state: DataFrame, pairs: set) -> DataFrame:
    """(n, syms): the longest runs of symbols whose neighbours are all in ``pairs``, once each with their counts."""
    wanted = np.array(sorted(left * _PAIR_SHIFT + right for left, right in pairs), np.int64)

    def run(batches):
        for n, flat, lens in _tables(batches):
            word = _word_ids(lens)
            p = flat[:-1] * _PAIR_SHIFT + flat[1:]
            known = wanted[np.minimum(np.searchsorted(wanted, p), len(wanted) - 1)] == p
            joined = np.append(known & (word[1:] == word[:-1]), False)
            ahead = np.append(False, joined[:-1])
            first, end = np.flatnonzero(joined & ~ahead), np.flatnonzero(ahead & ~joined)
            size = end - first + 1
            at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
            yield _arrow_words(n[word[first]], flat[at], size)
    return (state.select("n", "syms").mapInArrow(run, "n long, syms array<int>")
            .groupBy("syms").agg(F.sum("n").alias("n")).select("n", "syms"))


def _symbols(table: DataFrame) -> int:
    return table.agg(F.sum(F.size("syms"))).first()[0] or 0


def _window(state: DataFrame, local_symbols: int) -> tuple[DataFrame, int] | None:
    """(runs, floor): a table of at most ``local_symbols`` symbols that tells all merges of pairs with counts above ``floor``.

    A pair that merges make stands where two symbols stood side by side before, so its count is at most theirs: every
    pair that ever has a count above the floor, and all inside it, lies in runs of pairs that have one now.  None
    if not even the pairs of the highest count fit."""
    if _symbols(state) <= local_symbols:
        return state, 0
    top = pair_counts(state).orderBy(F.col("count").desc()).limit(WINDOW_PAIRS + 1).collect()
    best = int(top[0]["count"])
    floor = max(best // WINDOW_RATIO, int(top[-1]["count"]) if len(top) > WINDOW_PAIRS else 0)
    while True:
        floor = min(floor, best - 1)
        runs = frequent_runs(state, {(int(r["l"]), int(r["r"])) for r in top if r["count"] > floor}).checkpoint()
        if _symbols(runs) <= local_symbols:
            return runs, floor
        if floor == best - 1:
            return None
        floor = max(floor + 1, isqrt(floor * best))


def _learn_window(runs: DataFrame, *args) -> list[tuple[int, int, int]]:
    """``_merge_rounds`` over a size-checked table, in one task; only merges come back."""
    def run(batches):
        parts = [np.concatenate(x) for x in zip(*_tables(batches))]
        merges = _merge_rounds(*parts, *args) if parts else []
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(merges))], pa.int32()), *(pa.array([m[i] for m in merges], pa.int32()) for i in range(3))],
                                         ["k", "l", "r", "m"])

    rows = runs.select("n", "syms").coalesce(1).mapInArrow(run, "k int, l int, r int, m int").collect()
    return [(r["l"], r["r"], r["m"]) for r in sorted(rows, key=lambda r: r["k"])]


def learn_bpe(df: DataFrame, c: str = "text", vocab_size: int = 4048, specials=None,
              max_merges: int | None = None, checkpoint_every: int = 10, batch: int = 1,
              candidates: int = 64, local_symbols: int = LOCAL_SYMBOLS) -> BPEModel:
    """Learn specials + alphabet + merges until ``vocab_size`` tokens (or
    ``max_merges`` merges, or no pair left).

    Merges are learned window by window: all merges of counts above a floor come from a table of at most
    ``local_symbols`` symbols (``_window``), in one task, and are then applied to all words at once.  Where no such
    table fits (``local_symbols=0``: never) a round counts pairs over all words and applies one merge.

    With ``batch > 1`` a round counts pairs once and may apply several merges:
    only those that one-merge-per-round learning would pick next, in the same
    order (``_accept_batch``), so the result is identical to ``batch=1``."""
    spark = df.sparkSession
    specials = list(SPECIAL_TOKENS if specials is None else specials)
    ensure_checkpoint_dir(spark)
    # The words are stored before they are split: else Spark would split every occurrence for the filter below.
    words = word_counts(df, c).where(F.col("word").isNotNull()).checkpoint()
    # Written once: the alphabet and every round read this table.
    state = initial_symbols(words).where(F.size("syms") >= 1).checkpoint()
    alphabet = sorted(r["cp"] for r in state.select(F.explode("syms").alias("cp")).distinct().collect())
    sym_str: dict[int, str] = {cp: chr(cp) for cp in alphabet}
    str_sym: dict[str, int] = {v: k for k, v in sym_str.items()}
    tokens = specials + [chr(cp) for cp in alphabet if chr(cp) not in specials]
    known = set(tokens)
    merges: list[tuple[str, str, str]] = []
    # One-symbol words have no pair; they never change again.
    state = state.where(F.size("syms") >= 2)
    cached = stale = None
    rounds = n_merges = 0

    def learned(left: int, right: int, new: int) -> None:
        merged = sym_str[left] + sym_str[right]
        sym_str[new] = merged
        str_sym.setdefault(merged, new)
        merges.append((sym_str[left], sym_str[right], merged))
        if merged not in known:
            tokens.append(merged)
            known.add(merged)

    while len(tokens) < vocab_size and (max_merges is None or n_merges < max_merges):
        window = _window(state, local_symbols) if local_symbols and not state.isEmpty() else None
        if window:
            runs, floor = window
            found = _learn_window(runs, floor, vocab_size - len(tokens), None if max_merges is None else max_merges - n_merges,
                                  {s: t for s, t in sym_str.items() if s >= MERGED_BASE}, known, n_merges)
            for step in found:
                learned(*step)
            n_merges += len(found)
            if floor == 0 or not found:
                break
            if len(tokens) < vocab_size and (max_merges is None or n_merges < max_merges):
                state = apply_merges(state, found).checkpoint()
            for old in (stale, cached):
                if old is not None:
                    old.unpersist()
            stale = cached = None
            continue
        pc = pair_counts(state)
        if batch > 1:  # read twice (ranking and bounds)
            pc = pc.cache()
        top = pc.orderBy(F.col("count").desc(), "l", "r").limit(max(1, candidates if batch > 1 else 1)).collect()
        if stale is not None:  # ``state`` is materialised now; drop the round before it
            stale.unpersist()
            stale = None
        if not top:
            pc.unpersist()
            break
        bounds: dict = {}
        if batch > 1 and len(top) > 1:
            syms = sorted({int(r["l"]) for r in top} | {int(r["r"]) for r in top})
            into = pc.where(F.col("r").isin(syms)).groupBy(F.col("r").alias("s")).agg(F.max("count").alias("m")) \
                .withColumn("k", F.lit("into"))
            out_ = pc.where(F.col("l").isin(syms)).groupBy(F.col("l").alias("s")).agg(F.max("count").alias("m")) \
                .withColumn("k", F.lit("from"))
            bounds = {(r["k"], int(r["s"])): int(r["m"]) for r in into.unionByName(out_).collect()}
        pc.unpersist()
        left_budget = min(vocab_size - len(tokens),
                          (max_merges - n_merges) if max_merges is not None else vocab_size)
        expr = F.col("syms")
        accepted = _accept_batch(top, bounds, left_budget, max(1, batch))
        for left, right in accepted:
            merged = sym_str[left] + sym_str[right]
            duplicate = merged in str_sym
            new = str_sym.get(merged, MERGED_BASE + n_merges)
            learned(left, right, new)
            n_merges += 1
            # bound once per merge, so chaining merges keeps the expression linear
            expr = _merge_step(left, right, new)(expr) if len(accepted) == 1 else let(expr, _merge_step(left, right, new))
            if duplicate:  # an existing token gains occurrences: re-count before going on
                break
        rounds += 1
        nxt = state.withColumn("syms", expr)
        # Each round's table is materialised once: the next round reads it
        # instead of re-deriving every earlier merge.  A reliable checkpoint
        # every few rounds bounds the lineage an executor loss would replay.
        nxt = nxt.checkpoint() if rounds % checkpoint_every == 0 else nxt.cache()
        stale, cached = cached, (nxt if rounds % checkpoint_every else None)
        state = nxt
    if cached is not None:
        cached.unpersist()
    return BPEModel(tokens=tokens, merges=merges, specials=specials)


# --------------------------------------------------------------- encoding ----
def _merge_word(word: str, ranks: dict, tok2id: dict, unk: int) -> list[int]:
    """Repeatedly merge the adjacent pair of lowest rank (leftmost on ties): a
    linked list of symbols and a heap of pairs, O(L log L) for any length."""
    import heapq

    syms = list(word)
    n = len(syms)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        m = ranks.get((syms[i], syms[i + 1]))
        if m is not None:
            heap.append((m[0], i, syms[i], syms[i + 1]))
    heapq.heapify(heap)
    while heap:
        k, i, left, right = heapq.heappop(heap)
        j = after[i] if syms[i] is not None else n
        if j >= n or syms[i] != left or syms[j] != right:
            continue  # one of the two has been merged since
        syms[i], syms[j] = ranks[(left, right)][1], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n:
                m = ranks.get((syms[a], syms[b]))
                if m is not None:
                    heapq.heappush(heap, (m[0], a, syms[a], syms[b]))
    return [tok2id.get(s, unk) for s in syms if s is not None]


#: Words that a task remembers with their ids.
MEMO_WORDS = 200_000


def encode_tokens(model: BPEModel, unk: int = UNK):
    """Column function: pre-tokens (array of strings) -> struct(ids, word_ids), row by row in Arrow batches."""
    ranks: dict = {}
    for k, (l, r, m) in enumerate(model.merges):
        ranks.setdefault((l, r), (k, m))
    tok2id = model.token_to_id
    memo: dict[str, array] = {}

    @F.pandas_udf("ids array<int>, word_ids array<int>")
    def run(tokens: pd.Series) -> pd.DataFrame:
        ids, wids = [], []
        for row in tokens:
            parts = []
            for w in (() if row is None else row):
                got = memo.get(w)
                if got is None:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    got = memo[w] = array("i", _merge_word(w, ranks, tok2id, unk))
                parts.append(got)
            ids.append(np.frombuffer(b"".join(parts), np.int32))
            wids.append(np.repeat(np.arange(len(parts), dtype=np.int32), np.array([len(p) for p in parts], np.int64)))
        return pd.DataFrame({"ids": ids, "word_ids": wids})
    return run


def encode_columns(df: DataFrame, cols, model: BPEModel, key: str = "row_id", outs=None,
                   with_word_ids: bool = False) -> DataFrame:
    """(key, ids per column[, word ids]) for one or more text columns, one row per
    row of ``df`` (repeated and NULL keys are rows like others; a text without
    pre-tokens or a NULL text gets empty arrays).  Nothing is shuffled."""
    outs = list(outs or [f"{c}_ids" for c in cols])
    text_batches(df.sparkSession)
    run = encode_tokens(model)
    enc = df.select(key, *[run(pretokenize(c)).alias(f"_e{i}") for i, c in enumerate(cols)])
    sel = [F.col(key)]
    for i, o in enumerate(outs):
        sel.append(F.col(f"_e{i}.ids").alias(o))
        if with_word_ids:
            sel.append(F.col(f"_e{i}.word_ids").alias(f"{o}_word_ids" if len(outs) > 1 else "word_ids"))
    return enc.select(*sel)


def bpe_encode(df: DataFrame, c: str, model: BPEModel, key: str = "row_id", out: str = "ids",
               with_word_ids: bool = False) -> DataFrame:
    """Encode a text column and keep the other columns of ``df`` (row by row, no shuffle)."""
    text_batches(df.sparkSession)
    enc = df.withColumn("_e", encode_tokens(model)(pretokenize(c)))
    enc = enc.withColumn(out, F.col("_e.ids"))
    if with_word_ids:
        enc = enc.withColumn("word_ids", F.col("_e.word_ids"))
    return enc.drop("_e")


# --------------------------------------------------------------- decoding ----
def token_lookup(ids, model: BPEModel) -> Column:
    """id -> token through a literal array (size bounded by ``vocab_size``)."""
    vocab = F.array(*[F.lit(t) for t in model.tokens])
    return F.transform(col_of(ids), lambda i: F.try_element_at(vocab, i + 1))


def bpe_decode(ids, model: BPEModel, word_ids=None, mode: str = "space_join") -> Column:
    """Ids back to text, special tokens skipped.

    ``space_join`` joins every token with a space (a decoder-less tokenizer);
    ``words`` glues tokens of one word together (needs ``word_ids``)."""
    n_special = len(model.specials)
    toks = token_lookup(ids, model)
    if mode == "space_join" or word_ids is None:
        keep = F.filter(F.arrays_zip(col_of(ids).alias("i"), toks.alias("t")), lambda z: z["i"] >= F.lit(n_special))
        return F.array_join(F.transform(keep, lambda z: z["t"]), " ")
    z = F.arrays_zip(col_of(ids).alias("i"), toks.alias("t"), col_of(word_ids).alias("w"))
    keep = F.filter(z, lambda e: e["i"] >= F.lit(n_special))
    # A space before each token that starts a word; one join over all pieces keeps this linear.
    def pieces(k):
        return F.transform(k, lambda e, i: F.concat(F.when((i > 0) & (F.get(k, i - 1)["w"] != e["w"]), " ").otherwise(""), e["t"]))
    return F.array_join(let(keep, pieces), "")


def word_positions(c) -> Column:
    """Word index of each pre-token (the per-sentence word ids)."""
    return F.transform(pretokenize(c), lambda x, i: i)


# ------------------------------------------------------------- persisting ----
def save_bpe(model: BPEModel, spark: SparkSession, path: str) -> None:
    model.vocab_df(spark).write.mode("overwrite").parquet(f"{path}/vocab")
    model.merges_df(spark).write.mode("overwrite").parquet(f"{path}/merges")


def load_bpe(spark: SparkSession, path: str) -> BPEModel:
    vocab = spark.read.parquet(f"{path}/vocab").orderBy("id").collect()
    merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    specials = [r["token"] for r in vocab if r["special"]]
    return BPEModel(tokens=[r["token"] for r in vocab], merges=[(r["l"], r["r"], r["merged"]) for r in merges],
                    specials=specials)


def publish_bpe(model: BPEModel, spark: SparkSession, root: str) -> int:
    """Publish vocabulary and merges as one version: readers of an older one are not disturbed."""
    from lexiflow.sources.publish import publish

    special = set(model.specials)
    rows = [("token", i, t, None, None, t in special) for i, t in enumerate(model.tokens)]
    rows += [("merge", i, merged, left, right, None) for i, (left, right, merged) in enumerate(model.merges)]
    return publish(spark.createDataFrame(rows, "kind string, place int, token string, l string, r string, special boolean").coalesce(1), root)


def published_bpe(spark: SparkSession, root: str, version: int | None = None) -> BPEModel:
    from lexiflow.sources.publish import read_published

    rows = read_published(spark, root, version).orderBy("kind", "place").collect()
    tokens = [r for r in rows if r["kind"] == "token"]
    return BPEModel(tokens=[r["token"] for r in tokens], merges=[(r["l"], r["r"], r["token"]) for r in rows if r["kind"] == "merge"],
                    specials=[r["token"] for r in tokens if r["special"]])
