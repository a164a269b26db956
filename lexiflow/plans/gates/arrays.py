"""Gates for array functions and keyed noise (run on whole documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions import arrays as A
from lexiflow.operators import metrics as M
from lexiflow.operators import noise
from lexiflow.operators import udf as U
from lexiflow.plans import sqlfrag as q
from lexiflow.plans.registry import register
from lexiflow.sources import fixtures as fx

SEED, EPOCH = 1234, 0


def _ids(spark, sf):
    return fx.ids(spark, sf)


@register("noise_substitute", f"""with {q.ids_cte()}
select row_id, array_to_string({q.substitute('ids', str(SEED), str(EPOCH), 'row_id')}, ',') as ids from ids""")
def q_noise_substitute(spark, sf):
    d = _ids(spark, sf)
    return d.select("row_id", A.ids_text(noise.substitute("ids", SEED, EPOCH, "row_id")).alias("ids"))


@register("noise_insert", f"""with {q.ids_cte()}
select row_id, array_to_string({q.insert('ids', 'len(ids)', str(SEED), str(EPOCH), 'row_id')}, ',') as ids from ids""")
def q_noise_insert(spark, sf):
    d = _ids(spark, sf)
    return d.select("row_id", A.ids_text(noise.insert("ids", SEED, EPOCH, "row_id")).alias("ids"))


@register("noise_mixture", f"""with {q.ids_cte()}
select row_id, array_to_string({q.corrupt('ids', str(SEED), str(EPOCH), 'row_id')}, ',') as ids from ids""")
def q_noise_mixture(spark, sf):
    d = _ids(spark, sf)
    return d.select("row_id", A.ids_text(noise.corrupt("ids", SEED, EPOCH, "row_id")).alias("ids"))


@register("bos_eos", f"""with {q.ids_cte()}
select row_id, array_to_string([5] || ids || [6], ',') as wrapped,
       array_to_string(case when len(ids) = 0 then []::int[] else ids end, ',') as stripped from ids""")
def q_bos_eos(spark, sf):
    d = _ids(spark, sf).select("row_id", A.add_bos_eos("ids").alias("w"))
    return d.select("row_id", A.ids_text("w").alias("wrapped"), A.ids_text(A.strip_bos_eos("w")).alias("stripped"))


_NOISY_SQL = f"""with {q.ids_cte()},
noisy as (select row_id, {q.corrupt('ids', str(SEED), str(EPOCH), 'row_id')} as ids from ids)"""


def _noisy(spark, sf):
    return _ids(spark, sf).select("row_id", noise.corrupt("ids", SEED, EPOCH, "row_id").alias("ids"))


@register("pad_mask", _NOISY_SQL + """
select row_id, len(list_filter(ids, lambda x: x = 3))::int as n_masked,
       array_to_string(list_transform(ids, lambda x: x = 3), ',') as mask from noisy""")
def q_pad_mask(spark, sf):
    d = _noisy(spark, sf).select("row_id", A.pad_mask("ids").alias("m"))
    return d.select("row_id", F.size(F.filter("m", lambda x: x)).cast("int").alias("n_masked"),
                    F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("mask"))


@register("strip_pad", _NOISY_SQL + """
select row_id, array_to_string(list_filter(ids, lambda x: x <> 3), ',') as ids from noisy""")
def q_strip_pad(spark, sf):
    return _noisy(spark, sf).select("row_id", A.ids_text(A.strip_pad("ids")).alias("ids"))


@register("shift_pairs", f"""with {q.ids_cte()},
l as (select row_id, [5] || ids || [6] as lab from ids)
select row_id, array_to_string(lab[1:len(lab) - 1], ',') as decoder_input,
       array_to_string(lab[2:], ',') as target from l""")
def q_shift_pairs(spark, sf):
    d = _ids(spark, sf).select("row_id", A.shift_pairs(A.add_bos_eos("ids")).alias("s"))
    return d.select("row_id", A.ids_text("s.decoder_input").alias("decoder_input"),
                    A.ids_text("s.target").alias("target"))


@register("argmax_vec", """
select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as argmax from embeddings""")
def q_argmax(spark, sf):
    return fx.logits(spark, sf).select("vec_id", A.argmax("embedding").alias("argmax"))


_FRAMES_SQL = """with fr as (
  select vec_id, list_transform(range(0, 16), lambda f: embedding[f * 4 + 1: f * 4 + 4]) as frames from embeddings)"""


@register("ctc_collapse", _FRAMES_SQL + """,
b as (select vec_id, list_transform(frames, lambda x: (list_position(x, list_max(x)) - 1)::int) as best from fr)
select vec_id, array_to_string(list_filter(list_filter(best, lambda x, i: i = 1 or x <> best[i - 1]),
                                           lambda x: x <> 0), ',') as ids from b""")
def q_ctc_collapse(spark, sf):
    return fx.frames(spark, sf).select("vec_id", A.ids_text(A.ctc_collapse("frames")).alias("ids"))


@register("one_hot", """
select vec_id, array_to_string(list_transform(range(0, 10), lambda i: (i = label)::int), ',') as one_hot
from embeddings""")
def q_one_hot(spark, sf):
    return fx.logits(spark, sf).select("vec_id", A.ids_text(A.one_hot("label", 10)).alias("one_hot"))


@register("cross_entropy", """
with m as (select vec_id, label, embedding, list_max(embedding)::double as mx from embeddings)
select vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::double - mx)))) + mx
                     - embedding[label + 1]::double, 6) as loss from m""")
def q_cross_entropy(spark, sf):
    return fx.logits(spark, sf).select("vec_id", F.round(A.cross_entropy("embedding", "label"), 6).alias("loss"))


@register("one_hot_wide", """
select vec_id, 20000 as size, array_to_string([label], ',') as indices, 1 as n_entries from embeddings""")
def q_one_hot_wide(spark, sf):
    v = fx.logits(spark, sf).select("vec_id", A.one_hot_sparse("label", 20000).alias("v"))
    return v.select("vec_id", "v.size", A.ids_text("v.indices").alias("indices"), F.size("v.values").cast("int").alias("n_entries"))


@register("cross_entropy_mean", """
with m as (select vec_id // 8 as batch, case when vec_id % 4 = 0 then null else label end as label, embedding,
                  list_max(embedding)::double as mx from embeddings)
select batch::bigint as batch, round(avg(ln(list_sum(list_transform(embedding, lambda x: exp(x::double - mx)))) + mx
                     - embedding[label + 1]::double), 6) as loss, count(label)::bigint as n_positions from m group by 1""")
def q_cross_entropy_mean(spark, sf):
    d = fx.logits(spark, sf).select(F.floor(F.col("vec_id") / 8).cast("bigint").alias("batch"), "embedding",
                                    F.when(F.col("vec_id") % 4 == 0, F.lit(-100)).otherwise(F.col("label")).alias("target"))
    return M.cross_entropy_mean(d, "embedding", "target", ["batch"]).withColumn("loss", F.round("loss", 6))


@register("score_wer", _FRAMES_SQL + f""",
b as (select vec_id, list_transform(frames, lambda x: (list_position(x, list_max(x)) - 1)::int) as best from fr),
l as (select vec_id, best, list_transform(best, lambda x, i: case when (vec_id + i - 1) % 5 = 0 then (x + 1) % 4 else x end) as lab from b),
t as (select vec_id, list_transform(best, lambda x: 't' || x) as h, list_transform(lab, lambda x: 't' || x) as r from l)
select vec_id, {q.edit_distance('h', 'r')}::bigint as errors, len(r)::bigint as ref_words from t""")
def q_score_wer(spark, sf):
    """Score table -> best ids -> text -> word error rate, through the registered user metric."""
    fr = fx.frames(spark, sf)
    labels = F.transform(F.transform("frames", A.argmax), lambda x, i: F.when((F.col("vec_id") + i) % 5 == 0, (x + 1) % 4).otherwise(x))
    decode = lambda ids: F.array_join(F.transform(ids, lambda x: F.concat(F.lit("t"), x.cast("string"))), " ")
    s = fr.select("vec_id", U.metric("score_wer", "frames", labels, decode).alias("s"))
    return s.select("vec_id", "s.errors", "s.ref_words")


@register("position_features", _FRAMES_SQL + """,
x as (select vec_id, unnest(range(0, 16)) as frame, frames from fr),
y as (select vec_id, frame, unnest(range(0, 4)) as slot, frames[frame + 1] as v from x)
select vec_id, frame::int as frame, slot::int as slot,
       round(v[slot + 1]::double + case when slot % 2 = 0
             then sin(frame * exp((slot - slot % 2) * (-ln(10000.0) / 4)))
             else cos(frame * exp((slot - slot % 2) * (-ln(10000.0) / 4))) end, 6) as value
from y""")
def q_position_features(spark, sf):
    fr = fx.frames(spark, sf).select("vec_id", F.posexplode("frames").alias("frame", "v"))
    added = fr.select("vec_id", "frame", A.add_vectors("v", A.position_vector(F.col("frame"), 4)).alias("pv"))
    out = added.select("vec_id", F.col("frame").cast("int").alias("frame"),
                       F.posexplode("pv").alias("slot", "value"))
    return out.select("vec_id", "frame", F.col("slot").cast("int").alias("slot"), F.round("value", 6).alias("value"))
