"""Gates for file order, epochs by permutation and the join of heavy keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions import rng
from lexiflow.operators import epochs as ep
from lexiflow.operators import file_order as fo
from lexiflow.operators.skew import join_skewed
from lexiflow.plans import sqlfrag as q
from lexiflow.plans.registry import register
from lexiflow.sources import fixtures as fx
from lexiflow.sources.tables import table

FRACTIONS = (0.6, 0.8)
BATCH, SEED, EPOCHS = 8, 1234, (0, 1, 2)

# Up to 256 files in the order of their folders, rows by document; no column is a key and rows repeat.
_FILES_SQL = "f as (select lang, source, doc_id, substr(md5(doc_id::varchar), 1, 2) as bucket from documents)"


@register("file_order_split", f"""with {_FILES_SQL},
i as (select lang, source, row_number() over (order by bucket, doc_id) - 1 as idx, count(*) over () as n from f)
select idx, lang, source, case when idx < floor({FRACTIONS[0]}::double * n) then 'train' when idx < floor({FRACTIONS[1]}::double * n) then 'valid' else 'test' end as split from i""")
def q_file_order_split(spark, sf):
    path = fx.many_files(spark, sf)
    return fo.file_order_split(spark, path, FRACTIONS).select("idx", "lang", "source", "split")


@register("file_order_csv", f"""with {_FILES_SQL}
select row_number() over (order by bucket, doc_id) - 1 as idx, lang, source from f where lang <> 'en'""")
def q_file_order_csv(spark, sf):
    """A format without row numbers, and rows left out before numbering."""
    path = fx.many_files(spark, sf, fmt="csv")
    return fo.with_file_index(spark, path, "csv", schema="lang string, source string", keep=F.col("lang") != "en").select("idx", "lang", "source")


def _epoch_sql() -> str:
    def mix(x):
        turn = lambda v: f"((xor({v}, {v} >> {ep.SHIFT})) * {ep.FACTOR}) & {ep.MASK}"
        return (f"list_transform(list_transform(list_transform([({x}) & {ep.MASK}], lambda v: {turn('v')}), lambda v: {turn('v')}), "
                f"lambda v: xor(v, v >> {ep.SHIFT}))[1]")

    key = mix(f"{SEED}::bigint * 1000003 + epoch * 64 + t")
    network = lambda x: f"""list_transform([list_reduce(range(0, {ep.ROUNDS}), lambda acc, t: case when t % 2 = 0
        then {{'l': (acc.l + {mix(f"xor(acc.r, {key})")} % a) % a, 'r': acc.r}}
        else {{'l': acc.l, 'r': (acc.r + {mix(f"xor(acc.l, {key})")} % b) % b}} end, {{'l': ({x}) // b, 'r': ({x}) % b}})], lambda z: z.l * b + z.r)[1]"""  # noqa: E731
    return f"""with recursive p as (select doc_id::bigint as row_id, row_number() over (order by doc_id) - 1 as idx, count(*) over () as n from documents),
s as (select row_id, idx, n, ceil(sqrt(n))::bigint as a, ((n + ceil(sqrt(n))::bigint - 1) // ceil(sqrt(n))::bigint)::bigint as b, unnest({list(EPOCHS)})::bigint as epoch from p),
w as (select row_id, n, a, b, epoch, {network('idx')} as slot from s
      union all select row_id, n, a, b, epoch, {network('slot')} from w where slot >= n)
select row_id, epoch::int as epoch, slot // {BATCH} as batch_id, (slot % {BATCH})::int as batch_pos from w where slot < n"""


@register("epoch_batches", _epoch_sql())
def q_epoch_batches(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("row_id"))
    return ep.epoch_batches(docs, ["row_id"], BATCH, EPOCHS, SEED)


_HOT = "/hot/path"


@register("join_skewed", f"""with p as (select doc_id, case when {q.uniform(str(fx.SEED), "'hot'", 'doc_id')} < 0.5::double then '{_HOT}' else source || '/' || doc_id::varchar end as path, n_chars from documents),
r as (select path, system from (select distinct path from p), (select unnest(['base', 'beam', 'corrected']) as system))
select p.path, p.doc_id::bigint as row_id, p.n_chars, r.system from p join r on p.path = r.path""")
def q_join_skewed(spark, sf):
    hot = rng.uniform(fx.SEED, "hot", F.col("doc_id")) < F.lit(0.5)
    path = F.when(hot, F.lit(_HOT)).otherwise(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    rows = table(spark, sf, "documents").select(path.alias("path"), F.col("doc_id").cast("bigint").alias("row_id"), "n_chars")
    systems = rows.select("path").distinct().withColumn("system", F.explode(F.array(*[F.lit(s) for s in ("base", "beam", "corrected")])))
    return join_skewed(rows, systems, "path", left_salt=["row_id"])
