"""The registered digest query of each operator, with DuckDB SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import exact_dedup, hard_negatives, language_id, line_dedup, mixing, near_dedup, packing, quality_model, quality_rules, secrets, token_counts, token_files, whitening
from lexiflow.llm.common import documents, embeddings, held_out

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return put


@_query()
def op1_mix_sources(spark, sf_dir) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).drop("tkey")


@_query()
def op2_count_edits(spark, sf_dir) -> DataFrame:
    return token_counts.count_through_edits(documents(spark, sf_dir)).select(
        "doc_id", "n_tokens_before", "n_tokens", "n_edits", "n_segments", "segments_encoded", "chars_encoded")


@_query()
def op3_pack_binary(spark, sf_dir) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), with_ids=False)


@_query()
def op4_language_masks(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.learn_filter(docs.where(~held_out()))
    return language_id.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query("""
with h as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from h group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from h join g using (t)""")
def op5_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_dedup.dedup_exact(documents(spark, sf_dir), digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query()
def op6_random_secrets(spark, sf_dir) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(secrets.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        secrets.spans_text(F.col("found")).alias("spans"))


@_query(rf"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from win),
r as (select doc_id, i, count(*) over (partition by doc_id, g) as c from g),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from r where c > 1) group by 1),
c as (select doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(ls) as n_lines
      from w left join rep using (doc_id)),
b as (select *, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words as base_failed from c),
f as (select *, base_failed or 100 * n_symbols > {quality_rules.MAX_SYMBOL_PERCENT} * n_words
        or 100 * n_dup_lines > {quality_rules.MAX_DUP_LINE_PERCENT} * n_lines as rule_failed from b),
hosts as (select source, count(*) as n, sum(rule_failed::int)::double as f from f where source is not null group by 1),
total as (select sum(n)::double as nn, sum(f) / sum(n) as m from hosts),
spread as (select nn, m, count(*) as h, sum(n * (f / n - m) * (f / n - m)) as d, sum(n::double * n) as n2 from hosts, total group by all),
prior as (select m, 1 / greatest({1 / (1 + quality_rules.PRIOR_BOUNDS[1])}, least({1 / (1 + quality_rules.PRIOR_BOUNDS[0])},
  coalesce((d / nullif(m * (1 - m), 0) - (h - 1)) / nullif(nn - n2 / nn - (h - 1), 0), 0))) - 1 as k from spread),
shrunk as (select *, (f + m * k) / (n + k) as p from hosts, prior),
sure as (select source, m, p, p - {quality_rules.CERTAIN} * sqrt(p * (1 - p) / (n + k + 1)) as low from shrunk),
verdicts as (select source, p, case when low > {quality_rules.REJECT} then 'reject'
  when low > least({quality_rules.STRICT}, {quality_rules.STRICT_TIMES} * m) and low > 0 then 'strict' else 'pass' end as verdict from sure)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(verdict, 'pass') <> 'reject' and not (coalesce(verdict, 'pass') = 'strict' and rule_failed) as kept,
  rule_failed, source as host, round(p, 9) as host_rate, coalesce(verdict, 'pass') as host_verdict
from f left join verdicts using (source)""")
def op7_host_rules(spark, sf_dir) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_failed", "host",
        F.round("shrunk", 9).alias("host_rate"), F.col("verdict").alias("host_verdict"))


@_query()
def op8_boosted_quality(spark, sf_dir) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = quality_model.classify_quality(documents(spark, sf_dir), labels, learn_from=~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@_query()
def op9_token_files(spark, sf_dir) -> DataFrame:
    path = token_files.write_token_files(documents(spark, sf_dir))
    return token_files.read_token_files(spark, path, with_ids=False)


@_query()
def op10_near_dedup(spark, sf_dir) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).drop("tkey")


@_query(rf"""
with l as (select doc_id, unnest(range(len(ls))) as i, unnest(ls) as line from (
             select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{line_dedup._UPPER}', '{line_dedup._LOWER}') as key from l),
c as (select key, min(doc_id) as first from k where length(key) >= {line_dedup.MIN_CHARS} group by key having count(distinct doc_id) > 1),
d as (select k.*, c.first is not null and c.first <> k.doc_id as dropped from k left join c using (key))
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from d group by doc_id""")
def op11_line_dedup(spark, sf_dir) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@_query("""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda c: floor(256 * c::double)) as x
           from embeddings where label is not null and embedding is not null
             and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.x, b.x)::bigint as score
      from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from s where same) where r <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id)::int as rank
      from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5""")
def op12_hard_negatives(spark, sf_dir) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = embeddings(spark, sf_dir).withColumn("label", shifted)
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@_query()
def op13_whiten_vectors(spark, sf_dir) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))
