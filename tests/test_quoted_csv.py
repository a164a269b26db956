"""CSV with quoted line breaks in byte ranges, against the whole-file reader; the published tokenizer."""

from collections import Counter

import pytest
from pyspark.sql import types as T

from lexiflow.operators import bpe
from lexiflow.sources import io
from lexiflow.sources import quoted_csv as qc

SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("hyp", T.StringType()), T.StructField("ref", T.StringType())])


@pytest.fixture(params=[120, 1000, 100_000])
def ranges(spark, request):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], str(request.param))
    spark.conf.set(keys[1], "0")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def rows():
    hard = ['say "yes"', 'two\nlines', '"', '""', '\n', 'a,b', 'x\n"quoted\nlines"\nend', None, 'tail"', ',,\n,', 'è\n漢', "plain"]
    out = [(i, hard[i % len(hard)], "\n".join(["long line of words"] * (i % 9)) + f" {i}") for i in range(150)]
    return out + [(900, "\n" * 400, '"\n' * 60 + "after many ranges"), (901, "x", "y"), (901, "x", "y")]


@pytest.mark.parametrize("limit", [qc.BROADCAST_RANGES, 0])
def test_rows_equal_the_whole_file_reader(spark, scratch, ranges, monkeypatch, limit):
    monkeypatch.setattr(qc, "BROADCAST_RANGES", limit)
    df = spark.createDataFrame(rows(), SCHEMA)
    io.write_pairs(df.repartition(3), f"{scratch}/t")
    want = Counter(map(tuple, io.read_pairs(spark, f"{scratch}/t", schema=SCHEMA).collect()))
    assert sum(want.values()) == len(rows())
    got = qc.read_quoted_pairs(spark, f"{scratch}/t", schema=SCHEMA)
    assert Counter(map(tuple, got.collect())) == want and got.columns == SCHEMA.names
    files = qc.records(spark, f"{scratch}/t").select("file", "start").distinct()
    if ranges == 120:
        assert files.count() > 10 * files.select("file").distinct().count()


def test_windows_line_ends_and_empty_lines(spark, scratch):
    with open(f"{scratch}/x.csv", "wb") as f:
        f.write(b'row_id,hyp,ref\r\n1,"a\r\nb",c\r\n\r\n2,,"d ""e"""\r\n')
    want = sorted(map(tuple, io.read_pairs(spark, f"{scratch}/x.csv").collect()))
    assert sorted(map(tuple, qc.read_quoted_pairs(spark, f"{scratch}/x.csv").collect())) == want
    assert want[1][2] == 'd "e"'


def test_published_tokenizer_keeps_its_readers(spark, scratch):
    learn = lambda t: bpe.learn_bpe(spark.createDataFrame([(t,)], "text string"), "text", vocab_size=100, max_merges=5)
    a, b = learn("ab ab abc"), learn("xyz xyz zz")
    assert bpe.publish_bpe(a, spark, scratch) == 1 and bpe.publish_bpe(b, spark, scratch) == 2
    for version, m in ((1, a), (2, b), (None, b)):
        got = bpe.published_bpe(spark, scratch, version)
        assert (got.tokens, got.merges, got.specials) == (m.tokens, m.merges, m.specials)
