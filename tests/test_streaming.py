from lexiflow.streaming.scoring import read_pair_stream, score


def test_stream_scores_like_batch(spark, scratch):
    rows = [(1, "p", "a b c", "a b d"), (2, "q", "x", "x y")]
    spark.createDataFrame(rows, "row_id long, path string, hyp string, ref string").write.parquet(f"{scratch}/in")
    out = {}

    def sink(batch, _epoch):
        for r in batch.collect():
            out[r["row_id"]] = r["errors"]
    q = score(read_pair_stream(spark, f"{scratch}/in")).writeStream.foreachBatch(sink) \
        .option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert out == {1: 1, 2: 1}
