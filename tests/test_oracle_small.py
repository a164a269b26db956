"""Registered queries against their DuckDB statements on the smallest tables
(the full set at sf0.01 runs with ``python tests/oracle_check.py``)."""

import os

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_check import TABLES, rows_of

FAST = ["wer_rows", "wer_report", "join_systems", "build_path", "noise_mixture", "bos_eos", "pad_mask",
        "argmax_vec", "ctc_collapse", "cross_entropy", "position_features", "pretokenize", "word_counts",
        "bpe_pair_counts", "distinct_word_positions", "noise_substitute", "noise_insert", "delete_index", "greedy_decode", "exists_flag", "row_index",
        "positional_split", "offset_rows", "safe_map_ok", "batch_assign", "pad_batches", "epoch_metrics",
        "early_stop", "correct_words", "drop_inserted", "evaluate_systems", "wer_alignment", "turn_alignment", "word_confusions", "channel_counts",
        "file_order_split", "file_order_csv", "epoch_batches", "join_skewed"]


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    srows, snames = df.collect(), df.columns
    cur = duck.execute(E.oracle_sql()[name])
    dnames = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(snames) == sorted(dnames)
    assert rows_of(snames, srows) == rows_of(dnames, drows)


def test_every_query_has_callable_and_entry_runs(spark):
    import __spark_entry__ as E
    qs = E.queries()
    assert set(E.oracle_sql()) <= set(qs)
    out = E.entry(spark)
    assert set(out.columns) >= {"system", "macro_wer"} and out.count() > 0
