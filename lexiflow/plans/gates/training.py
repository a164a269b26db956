"""Gates for metric tables, early stopping, per-batch collation and the
training-batch table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.functions.arrays import ids_text
from lexiflow.operators import metrics as M
from lexiflow.operators import udf as U
from lexiflow.plans import sqlfrag as q
from lexiflow.plans.gates.tokenizer import _model
from lexiflow.plans.registry import register
from lexiflow.plans.training import build_batches
from lexiflow.sources import fixtures as fx

PATIENCE = 5
BATCH = 2

_LOG = """log as (select user_id::varchar as run, date_diff('day', date '2024-01-01', ts::date)::int as epoch,
                event_id::bigint as step, event_type as name, value::double as value,
                (1 + event_id % 4)::bigint as n_rows from events)"""
_EPOCHS = _LOG + """,
ep as (select run, epoch, name, sum(value * n_rows) / sum(n_rows)::double as value,
              sum(n_rows)::bigint as n_rows, count(*)::bigint as n_steps from log group by run, epoch, name)"""


@register("epoch_metrics", f"with {_EPOCHS} select run, epoch, name, round(value, 6) as value, n_rows, n_steps from ep")
def q_epoch_metrics(spark, sf):
    e = M.epoch_metrics(fx.metric_log(spark, sf))
    return e.withColumn("value", F.round("value", 6))


@register("early_stop", f"""with {_EPOCHS},
e as (select run, epoch, value, row_number() over (partition by run order by epoch) as k,
             min(value) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as pb
      from ep where name = 'click'),
f as (select *, max(case when pb is null or value < pb then k end)
                  over (partition by run order by epoch rows between unbounded preceding and current row) as li from e),
st as (select run, min(k) as sk from f where k - li >= {PATIENCE} group by run),
u as (select f.*, st.sk from f left join st using (run) where st.sk is null or f.k <= st.sk),
b as (select run, epoch, value, sk, k, row_number() over (partition by run order by value, k) as rn from u)
select run, max(case when rn = 1 then epoch end) as best_epoch, round(max(case when rn = 1 then value end), 6) as best_value,
       min(case when k = sk then epoch end) as stop_epoch, count(*)::bigint as n_epochs
from b group by run""")
def q_early_stop(spark, sf):
    e = M.early_stop(M.epoch_metrics(fx.metric_log(spark, sf)), "click", patience=PATIENCE)
    return e.withColumn("best_value", F.round("best_value", 6))


@register("collate", f"""with {q.ids_cte()},
b as (select row_id, ids, (row_number() over (order by md5(concat_ws('|', 1234, 0, row_id)), row_id) - 1) // {BATCH} as batch_id
      from ids)
select batch_id::bigint as batch_id, count(*)::bigint as n_rows, max(len(ids))::bigint as width,
       (count(*) * max(len(ids)) - sum(len(ids)))::bigint as n_pad from b group by batch_id""")
def q_collate(spark, sf):
    from lexiflow.operators.index import assign_batches

    def summarize(pdf):
        import pandas as pd
        lengths = pdf["ids"].map(len)
        return pd.DataFrame({"batch_id": [int(pdf["batch_id"].iloc[0])], "n_rows": [len(pdf)],
                             "width": [int(lengths.max())], "n_pad": [int(len(pdf) * lengths.max() - lengths.sum())]})
    b = assign_batches(fx.ids(spark, sf), BATCH, seed=1234, epoch=0)
    return U.collate(b.select("batch_id", "ids"), ["batch_id"], summarize,
                     "batch_id long, n_rows long, width long, n_pad long")


# No statement: the vocabulary is learned in full (see the tokenizer gates); tests compare with a plain version.
@register("training_batches")
def q_training_batches(spark, sf):
    b = build_batches(fx.pairs(spark, sf), _model(spark, sf), size=BATCH, seed=1234, epoch=0)
    return b.select("epoch", "batch_id", "batch_pos", "row_id", ids_text("input_ids").alias("input_ids"),
                    ids_text("labels").alias("labels"),
                    F.size(F.filter("input_pad", lambda x: x)).cast("int").alias("n_pad"),
                    ids_text("decoder_input").alias("decoder_input"), ids_text("target").alias("target"))
