"""Gates for sources/sinks, filters, existence, distincts, index, split and batches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.functions.arrays import add_bos_eos, ids_text
from lexiflow.functions.text import words
from lexiflow.operators import filters as flt
from lexiflow.operators import index as ix
from lexiflow.operators import udf as U
from lexiflow.operators.evaluate import drop_null
from lexiflow.plans import sqlfrag as q
from lexiflow.plans.registry import register
from lexiflow.sources import fixtures as fx
from lexiflow.sources import io
from lexiflow.sources.tables import table

PAIRS_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("path", T.StringType()),
                             T.StructField("hyp", T.StringType()), T.StructField("ref", T.StringType())])
SPLIT_FRACTIONS = (0.6, 0.8)
OFFSET = 150
BATCH = 2


@register("scan_pairs", f"with {q.pairs_cte()} select row_id, path, hyp, ref from pairs")
def q_scan_pairs(spark, sf):
    path = io.scratch_path(spark, "pairs-csv")
    io.write_pairs(fx.pairs(spark, sf), path)
    return io.read_pairs(spark, path, schema=PAIRS_SCHEMA)


@register("profile_pairs", f"""with {q.pairs_cte()}
select count(*)::bigint as n_rows, count_if(row_id is null)::bigint as null_row_id,
       count_if(path is null)::bigint as null_path, count_if(hyp is null)::bigint as null_hyp,
       count_if(ref is null)::bigint as null_ref, 4 as n_cols from pairs""")
def q_profile_pairs(spark, sf):
    return io.profile(fx.pairs(spark, sf))


@register("filter_blank_pairs", f"""with {q.pairs_cte()}
select row_id from pairs where hyp is not null and ref is not null
  and len({q.words('hyp')}) > 0 and len({q.words('ref')}) > 0""")
def q_filter_blank_pairs(spark, sf):
    return flt.drop_blank_pairs(fx.pairs(spark, sf)).select("row_id")


@register("exists_flag", """
select d.doc_id, (l.doc_id is not null) as has_label
from documents d left join (select distinct doc_id from labels where doc_id is not null) l on d.doc_id = l.doc_id""")
def q_exists_flag(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return flt.with_exists(d, table(spark, sf, "labels"), "doc_id", "has_label")


@register("n_distinct", "select count(distinct text)::bigint as n_distinct from documents")
def q_n_distinct(spark, sf):
    return flt.n_distinct(table(spark, sf, "documents"), "text")


@register("distinct_first_seen", """
select text as value, min(doc_id) as first_seen from documents group by text order by first_seen""")
def q_distinct_first_seen(spark, sf):
    return flt.distinct_ordered(table(spark, sf, "documents"), "text", "doc_id")


_NN = f"with {q.pairs_cte()}, nn as (select row_id, path from pairs where hyp is not null)"


@register("row_index", _NN + """
select row_id, (row_number() over (order by row_id) - 1)::bigint as idx from nn""")
def q_row_index(spark, sf):
    nn = drop_null(fx.pairs(spark, sf), ["hyp"]).select("row_id")
    return ix.with_row_index(nn, ["row_id"], "idx")


@register("positional_split", _NN + f""",
i as (select row_id, (row_number() over (order by row_id) - 1)::bigint as idx, count(*) over () as n from nn)
select row_id, idx, case when idx < floor({SPLIT_FRACTIONS[0]}::double * n) then 'train'
                         when idx < floor({SPLIT_FRACTIONS[1]}::double * n) then 'valid' else 'test' end as split
from i""")
def q_positional_split(spark, sf):
    nn = drop_null(fx.pairs(spark, sf), ["hyp"]).select("row_id")
    return ix.positional_split(nn, ["row_id"], SPLIT_FRACTIONS)


@register("positional_split_absolute", _NN + """,
i as (select row_id, (row_number() over (order by row_id) - 1)::bigint as idx from nn)
select row_id, idx, case when idx < 120 then 'train' when idx < 150 then 'valid' else 'test' end as split from i""")
def q_positional_split_absolute(spark, sf):
    """Fixed bounds, and one file per split read back."""
    nn = drop_null(fx.pairs(spark, sf), ["hyp"]).select("row_id")
    sp = ix.positional_split(nn, ["row_id"], (120, 150))
    path = io.scratch_path(spark, "splits")
    sp.write.partitionBy("split").parquet(path)
    return io.read_splits(spark, {s: f"{path}/split={s}" for s in ("train", "valid", "test")}).select("row_id", "idx", "split")


@register("preview_documents", "select doc_id, lang from documents order by doc_id limit 5")
def q_preview_documents(spark, sf):
    """The first rows of a table (a preview is the feature)."""
    return io.preview_rows(table(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id"), 5)


@register("cached_table", f"select doc_id, len({q.words('text')})::bigint as n_words from documents")
def q_cached_table(spark, sf):
    """A table written once and read again from its files."""
    path = io.scratch_path(spark, "cached")
    d = table(spark, sf, "documents")
    io.materialize(d.select("doc_id", F.size(words("text")).cast("bigint").alias("n_words")), path)
    return io.materialize(d.limit(0), path)


@register("scan_pandas_pairs", f"with {q.pairs_cte()} select row_id, path, hyp, ref from pairs")
def q_scan_pandas_pairs(spark, sf):
    """A file as a pandas sink writes it (unnamed index first, other column order), by name with a schema."""
    path = io.scratch_path(spark, "pandas-csv")
    d = fx.pairs(spark, sf).select(F.monotonically_increasing_id().alias(" "), "path", "ref", "hyp", "row_id")
    d.write.options(**io.CSV_OPTIONS).option("header", "true").csv(path)
    return io.read_pairs(spark, path, schema=PAIRS_SCHEMA)


@register("offset_rows", f"with {q.pairs_cte()} select row_id, path from pairs order by row_id offset {OFFSET}")
def q_offset_rows(spark, sf):
    return ix.offset_rows(fx.pairs(spark, sf).select("row_id", "path"), ["row_id"], OFFSET)


@register("read_splits", _NN + f""",
i as (select row_id, path, (row_number() over (order by row_id) - 1) as idx, count(*) over () as n from nn)
select row_id, path, case when idx < floor({SPLIT_FRACTIONS[0]}::double * n) then 'train' else 'validation' end as split
from i where idx < floor({SPLIT_FRACTIONS[1]}::double * n)""")
def q_read_splits(spark, sf):
    nn = drop_null(fx.pairs(spark, sf), ["hyp"]).select("row_id", "path")
    sp = ix.positional_split(nn, ["row_id"], SPLIT_FRACTIONS)
    base = io.scratch_path(spark, "splits")
    io.write_pairs(sp.where("split = 'train'").select("row_id", "path"), f"{base}/train.csv")
    sp.where("split = 'valid'").select("row_id", "path").write.parquet(f"{base}/valid.parquet")
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("path", T.StringType())])
    return io.read_splits(spark, {"train": f"{base}/train.csv", "validation": f"{base}/valid.parquet"}, schema)


@register("safe_map", """
select event_id, try_cast(raw as double) as result, (try_cast(raw as double) is null) as failed
from (select event_id::bigint as event_id, case when """ + q.uniform("42", "'bad'", "event_id") + """ < 0.08::double
      then 'bad' else value::varchar end as raw from events)""")
def q_safe_map(spark, sf):
    r = U.safe_map(fx.fallible(spark, sf), float, "raw", T.DoubleType())
    return r.select("event_id", "result", F.col("error").isNotNull().alias("failed"))


@register("safe_map_ok", """
select event_id, try_cast(raw as double) as result
from (select event_id::bigint as event_id, case when """ + q.uniform("42", "'bad'", "event_id") + """ < 0.08::double
      then 'bad' else value::varchar end as raw from events) where try_cast(raw as double) is not null""")
def q_safe_map_ok(spark, sf):
    r = U.drop_failed(U.safe_map(fx.fallible(spark, sf), float, "raw", T.DoubleType()))
    return r.select("event_id", "result")


@register("map_batches", f"select doc_id, len({q.words('text')})::bigint as n_words from documents")
def q_map_batches(spark, sf):
    def count_words(pdf):
        import pandas as pd
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": pdf["text"].map(lambda t: len(t.split())).astype("int64")})
    d = table(spark, sf, "documents").select("doc_id", "text")
    return U.map_batches(d, count_words, "doc_id long, n_words long")


_BATCH_SQL = f"""with {q.ids_cte()},
b as (select row_id, ids, (row_number() over (order by md5(concat_ws('|', 1234, 0, row_id)), row_id) - 1) as idx from ids)"""


@register("batch_assign", _BATCH_SQL + f"""
select row_id, 0 as epoch, (idx // {BATCH})::bigint as batch_id, (idx % {BATCH})::int as batch_pos from b""")
def q_batch_assign(spark, sf):
    b = ix.assign_batches(fx.ids(spark, sf).select("row_id"), BATCH, seed=1234, epoch=0)
    return b.select("row_id", "epoch", "batch_id", "batch_pos")


@register("pad_batches", _BATCH_SQL + f""",
w as (select row_id, idx // {BATCH} as batch_id, [5] || ids || [6] as lab from b),
m as (select *, max(len(lab)) over (partition by batch_id) as mx from w)
select row_id, batch_id::bigint as batch_id,
       array_to_string(lab || list_transform(range(mx - len(lab)), lambda x: 3), ',') as labels from m""")
def q_pad_batches(spark, sf):
    d = fx.ids(spark, sf).select("row_id", add_bos_eos("ids").alias("labels"))
    b = ix.pad_batches(ix.assign_batches(d, BATCH, seed=1234, epoch=0), ["labels"])
    return b.select("row_id", "batch_id", ids_text("labels").alias("labels"))


@register("file_extension", """
select page_id, string_split(url, '.')[-1] as ext,
       case when lower(string_split(url, '.')[-1]) in ('csv', 'raw') then 'csv'
            else lower(string_split(url, '.')[-1]) end as fmt
from pages""")
def q_file_extension(spark, sf):
    from lexiflow.functions.text import file_extension, reader_format
    p = table(spark, sf, "pages")
    return p.select("page_id", file_extension("url").alias("ext"), reader_format("url").alias("fmt"))

