"""Plan properties: scans read only the columns they need."""

import os

import pytest

from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="driver tables not present")
def test_scans_are_pruned(spark):
    import __spark_entry__ as E
    q = E.queries()
    p = _plan(q["exists_flag"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint>" in p                       # documents: one column of five
    p = _plan(q["argmax_vec"](spark, SF_SMALL))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p
    p = _plan(q["epoch_metrics"](spark, SF_SMALL))
    assert "props" not in p.split("ReadSchema:")[1].split("\n")[0]        # unused JSON column never read
