"""Scoring and projection gates: one per operator of the inventory, each paired with an
independent DuckDB statement over the same driver tables.

Every query reads the driver tables (or data Spark derives from them) whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.operators import evaluate as ev
from lexiflow.plans import sqlfrag as q
from lexiflow.plans.registry import register
from lexiflow.sources import fixtures as fx


def _r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- scoring ----
_SCORED_PAIRS_SQL = f"""with {q.pairs_cte()},
p as (select row_id, {q.words('hyp')} as h, {q.words('ref')} as r from pairs where hyp is not null),
s as (select row_id, {q.edit_distance('h', 'r')}::bigint as errors, len(r)::bigint as ref_words from p)"""


@register("wer_rows", _SCORED_PAIRS_SQL + """
select row_id, errors, ref_words,
       round(case when ref_words = 0 then null else errors::double / ref_words end, 6) as wer
from s""")
def q_wer_rows(spark, sf):
    pairs = ev.drop_null(fx.pairs(spark, sf), ["hyp"])
    r = ev.wer_rows(pairs)
    return r.withColumn("wer", _r6(F.col("wer")))


@register("wer_histogram", _SCORED_PAIRS_SQL + """
select round(errors::double / ref_words, 6) as wer, count(*)::bigint as n_rows
from s where ref_words > 0 group by 1 order by 1""")
def q_wer_histogram(spark, sf):
    pairs = ev.drop_null(fx.pairs(spark, sf), ["hyp"])
    return ev.wer_histogram(ev.wer_rows(pairs))


_JOINED_SQL = f"""with {q.pairs_cte()}, {q.pseudo_cte()},
ps as (select '' || substr(output_dir, 3) || audio_part_name as path, beam from pseudo),
j as (select ps.path, pairs.row_id, pairs.hyp, pairs.ref, ps.beam
      from ps join pairs on ps.path = pairs.path where pairs.hyp is not null)"""


@register("join_systems", _JOINED_SQL + """
select path, row_id, hyp, beam from j""")
def q_join_systems(spark, sf):
    return _joined(spark, sf).select("path", "row_id", "hyp", "beam")


def _joined(spark, sf):
    pairs = fx.pairs(spark, sf).select("path", "row_id", "hyp", "ref")
    other = ev.pseudo_with_path(fx.pseudo(spark, sf))
    return ev.drop_null(ev.join_systems(other, pairs, on="path"), ["hyp"])


@register("wer_report", _JOINED_SQL + f""",
u as (select row_id, 'base' as system, hyp as text, ref from j
      union all select row_id, 'beam', beam, ref from j),
p as (select system, {q.words('text')} as h, {q.words('ref')} as r from u),
s as (select system, {q.edit_distance('h', 'r')}::bigint as errors, len(r)::bigint as ref_words from p)
select system, count(*)::bigint as n_rows, sum(errors)::bigint as errors, sum(ref_words)::bigint as ref_words,
       round(avg(case when ref_words = 0 then null else errors::double / ref_words end), 6) as macro_wer,
       round(sum(errors)::double / sum(ref_words), 6) as micro_wer
from s group by system""")
def q_wer_report(spark, sf):
    j = _joined(spark, sf).withColumnRenamed("hyp", "base")
    u = ev.unpivot_systems(j, ["row_id", "ref"], ["base", "beam"], "system", "text")
    return ev.wer_report(ev.with_wer(u, "text", "ref"), by=["system"])


# ------------------------------------------------------------- projection ----
@register("build_path", f"""with {q.pseudo_cte()}
select '' || substr(output_dir, 3) || audio_part_name as path, beam from pseudo""")
def q_build_path(spark, sf):
    return ev.pseudo_with_path(fx.pseudo(spark, sf))


@register("filter_not_null", f"""with {q.pairs_cte()}
select row_id, path from pairs where hyp is not null""")
def q_filter_not_null(spark, sf):
    return ev.drop_null(fx.pairs(spark, sf), ["hyp"]).select("row_id", "path")


@register("project_pairs", f"""with {q.pairs_cte()}
select row_id, path, hyp, ref from pairs""")
def q_project_pairs(spark, sf):
    return fx.pairs(spark, sf).select("row_id", "path", "hyp", "ref")
