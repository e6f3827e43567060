"""The streaming extension: a stream over files gives what the batch gives; merges and attempts keep state."""

from pyspark.sql import functions as F

from tessella.streaming import runlog

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_windows_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(4).write.parquet(f"{tmp_path}/in")
    log = runlog.log_stream(spark, f"{tmp_path}/in", batch.schema)
    q = runlog.windowed_counts(log, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in runlog.windowed_counts(batch, "ts", "event_type").collect()}
    assert {tuple(r) for r in spark.table("w").collect()} == want


def test_merge_is_idempotent(spark, tmp_path):
    write = runlog.merge_into(f"{tmp_path}/t", ["k"], "v")
    a = spark.createDataFrame([(1, 1), (2, 1)], "k int, v int")
    b = spark.createDataFrame([(2, 2), (3, 1)], "k int, v int")
    write(a, 0)
    for _ in range(2):
        write(b, 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t/generation=1").collect()) == [(1, 1), (2, 2), (3, 1)]


def test_attempts(spark, tmp_path):
    rows = [("a", "error")] * 3 + [("b", "error"), ("b", "ok")]
    spark.createDataFrame(rows, "item string, state string").write.parquet(f"{tmp_path}/in")
    log = runlog.log_stream(spark, f"{tmp_path}/in", "item string, state string")
    q = runlog.attempts(log, "item", "state").writeStream.format("memory").queryName("att").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.item, r.failed, r.given_up) for r in spark.table("att").collect()} == {("a", 3, True), ("b", 1, False)}
