from pyspark.sql import functions as F

from lexiflow.functions.text import pretokenize
from lexiflow.operators import bpe


def _learn(spark, texts, merges, vocab_size=1000):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return bpe.learn_bpe(df, "text", vocab_size=vocab_size, max_merges=merges)


def test_overlap_aaa(spark):
    df = spark.createDataFrame([("aaa",)], "text string")
    pc = bpe.pair_counts(bpe.initial_symbols(bpe.word_counts(df))).collect()
    assert [(r["l"], r["r"], r["count"]) for r in pc] == [(97, 97, 2)]       # overlapping pair counted twice
    m = _learn(spark, ["aaa"], 1)
    assert m.merges == [("a", "a", "aa")]
    enc = bpe.encode_columns(spark.createDataFrame([(1, "aaa")], "row_id long, text string"), ["text"], m, outs=["ids"]).first()["ids"]
    assert [m.tokens[i] for i in enc] == ["aa", "a"]                           # left to right, no overlap


def test_specials_alphabet_ids_and_tie_break(spark):
    m = _learn(spark, ["ab cd"], 1)                                            # (a,b) and (c,d) tie at 1
    assert m.tokens[:7] == ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]", "<s>", "</s>"]
    assert m.tokens[7:11] == ["a", "b", "c", "d"]                              # alphabet by code point
    assert m.merges == [("a", "b", "ab")]                                      # lowest left id wins the tie


def test_count_beats_id_and_vocab_limit(spark):
    m = _learn(spark, ["xy xy ab"], 5, vocab_size=7 + 4 + 1)
    assert m.merges[0] == ("x", "y", "xy")
    assert len(m.tokens) == 12                                                 # stops at vocab_size


def test_one_letter_word_unknown_char_and_delimiter(spark):
    m = _learn(spark, ["ab ab a"], 1)
    docs = spark.createDataFrame([(1, "a ab zq|"), (2, "   ")], "row_id long, text string")
    out = {r["row_id"]: r["ids"] for r in bpe.bpe_encode(docs, "text", m).collect()}
    tok = m.token_to_id
    assert out[1] == [tok["a"], tok["ab"], 0, 0, 0]                            # unknown characters -> [UNK]
    assert out[2] == []


def test_round_trip_words_mode(spark):
    texts = ["the cat sat on the mat, the end.", "Ünïcode wörds héré!", "x"]
    m = _learn(spark, texts, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    enc = bpe.bpe_encode(docs, "text", m, with_word_ids=True)
    out = enc.select(bpe.bpe_decode("ids", m, "word_ids", mode="words").alias("d"),
                     F.array_join(pretokenize("text"), " ").alias("p")).collect()
    assert all(r["d"] == r["p"] for r in out)


def test_save_load(spark, scratch):
    m = _learn(spark, ["hello hello world"], 3)
    bpe.save_bpe(m, spark, scratch)
    m2 = bpe.load_bpe(spark, scratch)
    assert m2.tokens == m.tokens and m2.merges == m.merges and m2.specials == m.specials


def test_merge_word_priority():
    ranks = {("a", "b"): (0, "ab"), ("b", "c"): (1, "bc"), ("ab", "c"): (2, "abc")}
    tok = {"a": 1, "b": 2, "c": 3, "ab": 4, "bc": 5, "abc": 6}
    assert bpe._merge_word("abc", ranks, tok, 0) == [6]
    assert bpe._merge_word("bcab", ranks, tok, 0) == [5, 4]


def test_batched_rounds_equal_single_merge_rounds(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "then there were three thin thieves",
             "she sells sea shells by the sea shore", "aaaa abab baba the the the", "ünïcödé wörds über alles"]
    df = spark.createDataFrame([(t,) for t in texts * 3], "text string")
    one = bpe.learn_bpe(df, "text", max_merges=40, batch=1, local_symbols=0)
    many = bpe.learn_bpe(df, "text", max_merges=40, batch=16, local_symbols=0)
    assert one.merges == many.merges and one.tokens == many.tokens
    capped = bpe.learn_bpe(df, "text", vocab_size=len(one.tokens) - 5, batch=16, local_symbols=0)
    assert capped.tokens == one.tokens[:len(one.tokens) - 5]


def _plain_trainer(texts, limit):
    """Recounts all pairs of all words for every merge."""
    import re
    from collections import Counter
    counts = Counter(w for t in texts for w in re.findall(r"\w+|[^\w\s]+", t))
    words = [(list(w), n) for w, n in counts.items()]
    ids, merges = {}, []
    rank = lambda t: ids.get(t, ord(t[0]) if len(t) == 1 else 0)
    while len(merges) < limit:
        pairs = Counter()
        for s, n in words:
            for p in zip(s, s[1:]):
                pairs[p] += n
        if not pairs:
            break
        l, r = min(pairs, key=lambda p: (-pairs[p], rank(p[0]), rank(p[1])))
        merges.append((l, r, l + r))
        ids.setdefault(l + r, (1 << 21) + len(merges) - 1)
        for s, _ in words:
            i = 0
            while i < len(s) - 1:
                if (s[i], s[i + 1]) == (l, r):
                    s[i:i + 2] = [l + r]
                i += 1
    return merges


def test_full_vocabulary_equals_plain_trainer_and_rounds(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "then there were three thin thieves", "aaaa abab baba aaa",
             "she sells sea shells by the sea shore", "ünïcödé wörds über alles, ab a b!! !!!"] * 2
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    full = bpe.learn_bpe(df, "text", vocab_size=4048)                          # until no pair is left
    assert full.merges == _plain_trainer(texts, 4048)
    part = bpe.learn_bpe(df, "text", max_merges=25, local_symbols=0)
    assert part.merges == full.merges[:25]
    short = bpe.learn_bpe(df, "text", vocab_size=len(part.tokens))
    assert short.tokens == part.tokens


def test_gate_model_is_full_size(spark):
    from lexiflow.plans.gates import tokenizer as g
    from tests.conftest import SF_SMALL
    m = g._model(spark, SF_SMALL)
    assert len(m.tokens) == 4048
    look = g.q_vocab_lookup(spark, SF_SMALL)
    rows = look.collect()
    assert all(r["id"] == r["id_back"] and r["token"] == m.tokens[r["id"]] for r in rows)
    enc = {r["row_id"]: r["ids"] for r in g.q_bpe_encode(spark, SF_SMALL).collect()}
    assert sum(r["n_uses"] for r in rows) == sum(len(x.split(",")) for x in enc.values() if x)
    assert all(r["same"] for r in g.q_bpe_save_load(spark, SF_SMALL).collect())
    words = {r["row_id"]: (r["words"], r["space_join"]) for r in g.q_bpe_decode(spark, SF_SMALL).collect()}
    pre = {r["doc_id"]: r["joined"] for r in g.q_pretokenize(spark, SF_SMALL).collect()}
    assert {k: w for k, (w, _) in words.items()} == pre
    assert all(s.replace(" ", "") == w.replace(" ", "") for w, s in words.values())
    # Encoding by the merges in rank order, word by word, for a few whole documents.
    for k in sorted(enc)[:3]:
        out = []
        for w in pre[k].split(" "):
            s = list(w)
            for l, r, x in m.merges:
                i = 0
                while i < len(s) - 1:
                    if s[i] == l and s[i + 1] == r:
                        s[i:i + 2] = [x]
                    i += 1
            out += [m.token_to_id[t] for t in s]
        assert ",".join(map(str, out)) == enc[k]


def test_encode_without_shuffle_and_long_token(spark):
    import time
    m = _learn(spark, ["ab ab abab aaaa"], 5)
    docs = spark.createDataFrame([(1, "ab aaaa"), (1, "ab"), (None, "abab"), (2, None)], "row_id long, text string")
    enc = bpe.bpe_encode(docs, "text", m, with_word_ids=True)
    assert "Exchange" not in enc._jdf.queryExecution().executedPlan().toString()
    assert enc.count() == 4
    ranks = {(l, r): (k, x) for k, (l, r, x) in reversed(list(enumerate(m.merges)))}
    t0 = time.time()
    bpe._merge_word("ab" * 50_000, ranks, m.token_to_id, 0)
    assert time.time() - t0 < 2


def test_windows_equal_plain_trainer(spark):
    """Windows of small tables: many floors, doubled tokens ("abc" from a + bc and ab + c) and runs of one letter."""
    import random
    draw = random.Random(5)
    texts = ["".join(draw.choice("abcab ") for _ in range(60)) for _ in range(30)] + ["aaaa aaa aaaaaaa bcbcbc", "x", ""]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    plain = _plain_trainer(texts, 120)
    for size in (400, 120):
        assert bpe.learn_bpe(df, "text", max_merges=120, local_symbols=size).merges == plain
    few = bpe.learn_bpe(df, "text", max_merges=8, local_symbols=120)
    assert few.merges == plain[:8]


def test_replayed_merges_equal_one_after_the_other():
    import random
    draw = random.Random(3)
    merges = [(97, 98, 1000), (98, 99, 1001), (1000, 99, 1002), (1002, 100, 1003), (97, 1001, 1002), (1002, 100, 1003), (97, 97, 1004)]
    steps = {}
    for k, (left, right, new) in enumerate(merges):
        steps.setdefault((left, right), []).append((k, new))
    for _ in range(300):
        syms = [draw.randint(97, 100) for _ in range(draw.randint(0, 14))]
        want = list(syms)
        for left, right, new in merges:
            i = 0
            while i < len(want) - 1:
                if (want[i], want[i + 1]) == (left, right):
                    want[i:i + 2] = [new]
                i += 1
        assert bpe._replay(list(syms), steps) == want


def test_encoding_bounds_its_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    m = bpe.BPEModel(tokens=["[UNK]", "a"], merges=[], specials=["[UNK]"])
    docs = spark.createDataFrame([(1, "a b", [7, 8])], "row_id long, text string, ids array<int>")
    from lexiflow.operators import noise
    from lexiflow.session import ROWS_PER_BATCH
    for use in (lambda: bpe.encode_columns(docs, ["text"], m), lambda: bpe.bpe_encode(docs, "text", m), lambda: noise.corrupt("ids", 1, 0, "row_id")):
        spark.conf.set(name, "10000")
        use()
        assert int(spark.conf.get(name)) <= ROWS_PER_BATCH


def test_words_are_split_and_counted_on_arrays(spark):
    df = spark.createDataFrame([(3, "ab\U0001d11ec"), (2, "a"), (1, None), (4, ""), (5, "ab")], "n int, word string")
    state = bpe.initial_symbols(df)
    assert {r["n"]: r["syms"] for r in state.collect()} == {3: [97, 98, 0x1d11e, 99], 2: [97], 1: None, 4: [], 5: [97, 98]}
    assert {(r["l"], r["r"]): r["count"] for r in bpe.pair_counts(state).collect()} == {(97, 98): 8, (98, 0x1d11e): 3, (0x1d11e, 99): 3}
    runs = bpe.frequent_runs(state.where("n > 1"), {(97, 98), (0x1d11e, 99)})
    assert {tuple(r["syms"]): r["n"] for r in runs.collect()} == {(97, 98): 8, (0x1d11e, 99): 3}


def test_many_words_learned_in_one_window_within_seconds():
    """300,000 symbols, 2,000 merges: symbol by symbol in Python this took many times as long."""
    import random
    import time

    import numpy as np
    draw = random.Random(1)
    words = [[97 + min(int(draw.expovariate(0.15)), 25) for _ in range(10)] for _ in range(30_000)]
    n = np.array([draw.randint(1, 50) for _ in words], np.int64)
    t0 = time.time()
    merges = bpe._merge_rounds(n, np.array(words, np.int64).ravel(), np.full(len(words), 10, np.int64), 0, 2_000, None, {}, set(), 0)
    assert len(merges) == 2_000 and time.time() - t0 < 4
