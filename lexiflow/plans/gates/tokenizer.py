"""Gates for pre-tokens, word counts, BPE learning, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions.arrays import ids_text
from lexiflow.functions.text import pretokenize, words
from lexiflow.operators import bpe
from lexiflow.plans import sqlfrag as q
from lexiflow.plans.registry import register
from lexiflow.session import ensure_checkpoint_dir
from lexiflow.sources import fixtures as fx
from lexiflow.sources import io, publish
from lexiflow.sources.tables import table

VOCAB_SIZE = 4048  # the reference's vocabulary
CORPUS = ("documents", "benchmark", "conversations")


def _model_path(spark, sf):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexiflow-bpe/{fx.fingerprint(spark, sf, CORPUS)}"


def _learn(spark, sf):
    """Learn from the corpus and publish the model in the shared folder, under the fingerprint of its files."""
    model = bpe.learn_bpe(fx.corpus(spark, sf), "text", vocab_size=VOCAB_SIZE)
    bpe.publish_bpe(model, spark, _model_path(spark, sf))
    return model


def _model(spark, sf):
    """The model published for these files; learned first if there is none."""
    path = _model_path(spark, sf)
    return bpe.published_bpe(spark, path) if publish.versions(spark, path) else _learn(spark, sf)


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("row_id"), "text")


@register("word_split", f"""
select doc_id, len({q.words('text')})::int as n_words, array_to_string({q.words('text')}, ' ') as joined
from documents""")
def q_word_split(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(words("text")).cast("int").alias("n_words"),
                    F.array_join(words("text"), " ").alias("joined"))


@register("pretokenize", f"""
select doc_id, len({q.pretokens('text')})::int as n_tokens, array_to_string({q.pretokens('text')}, ' ') as joined
from documents""")
def q_pretokenize(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(pretokenize("text")).cast("int").alias("n_tokens"),
                    F.array_join(pretokenize("text"), " ").alias("joined"))


@register("corpus_union", f"""with {q.corpus_cte()} select text from corpus""")
def q_corpus_union(spark, sf):
    return fx.corpus(spark, sf)


@register("word_counts", f"""with {q.bpe_learn_ctes(0)} select word, n from words""")
def q_word_counts(spark, sf):
    return bpe.word_counts(fx.corpus(spark, sf), "text")


@register("bpe_pair_counts", f"""with {q.bpe_learn_ctes(1)} select l, r, cnt as count from pc0""")
def q_bpe_pair_counts(spark, sf):
    state = bpe.initial_symbols(bpe.word_counts(fx.corpus(spark, sf), "text"))
    pc = bpe.pair_counts(state)
    ch = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "utf-32")
    return pc.select(ch(F.col("l")).alias("l"), ch(F.col("r")).alias("r"), "count")


# The five queries below use the whole vocabulary.  In SQL each of its some thousand merges would be a
# pass over all words, so tests compare them with a plain trainer and encoder on the small tables.
@register("bpe_merges")
def q_bpe_merges(spark, sf):
    return _learn(spark, sf).merges_df(spark)


@register("vocab_lookup")
def q_vocab_lookup(spark, sf):
    """Ids of all documents looked up in the vocabulary table: token, uses, and the id found back by the token."""
    m = _model(spark, sf)
    vocab = m.vocab_df(spark)
    uses = bpe.encode_columns(_docs(spark, sf), ["text"], m, outs=["ids"]).select(F.explode("ids").alias("id"))
    found = uses.groupBy("id").agg(F.count(F.lit(1)).alias("n_uses")).join(vocab, "id", "left")
    back = vocab.select("token", F.col("id").alias("id_back"))
    return found.join(back, "token", "left").select("id", "token", "special", "n_uses", "id_back")


@register("bpe_encode")
def q_bpe_encode(spark, sf):
    enc = bpe.encode_columns(_docs(spark, sf), ["text"], _model(spark, sf), outs=["ids"])
    return enc.select("row_id", ids_text("ids").alias("ids"))


@register("bpe_decode")
def q_bpe_decode(spark, sf):
    m = _model(spark, sf)
    enc = bpe.encode_columns(_docs(spark, sf), ["text"], m, outs=["ids"], with_word_ids=True)
    return enc.select("row_id", bpe.bpe_decode("ids", m, mode="space_join").alias("space_join"),
                      bpe.bpe_decode("ids", m, "word_ids", mode="words").alias("words"))


@register("bpe_save_load")
def q_bpe_save_load(spark, sf):
    """A saved and loaded model gives the same ids for every document."""
    m = _model(spark, sf)
    path = io.scratch_path(spark, "bpe")
    bpe.save_bpe(m, spark, path)
    again = bpe.load_bpe(spark, path)
    a = bpe.bpe_encode(_docs(spark, sf), "text", m, out="a")
    return bpe.bpe_encode(a, "text", again, out="b").select(
        "row_id", F.size("a").cast("int").alias("n_ids"), (F.col("a") == F.col("b")).alias("same"))


@register("distinct_word_positions", f"""
with p as (select {q.pretokens('text')} as t from documents)
select (select count(distinct i) from (select unnest(range(len(t))) as i from p))::bigint as n_positions,
       (select max(len(t)) from p)::bigint as max_words""")
def q_distinct_word_positions(spark, sf):
    # One scan: the positions of all words, counted; the largest is the longest text's word count less one.
    i = table(spark, sf, "documents").select(F.explode(bpe.word_positions("text")).alias("i"))
    return i.agg(F.count_distinct("i").cast("bigint").alias("n_positions"),
                 F.coalesce(F.max("i") + 1, F.lit(0)).cast("bigint").alias("max_words"))
