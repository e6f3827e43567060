"""Timers, restarts and merges of the queue's streams."""

import time

import pytest
from pyspark.sql import functions as F

from tessella.streaming import queue, runlog


@pytest.fixture
def timers(spark):
    before = spark.conf.get(queue.STATE_STORE[0])
    queue.use_timers(spark)
    yield
    spark.conf.set(queue.STATE_STORE[0], before)


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("parquet" if mode == "append" else "memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/check-{name}")
    q = (q.option("path", f"{tmp_path}/out-{name}") if mode == "append" else q).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_watchdog_fires_after_a_restart(spark, tmp_path, timers):
    schema = "item string, state string, ts timestamp"

    def put(n, rows):
        spark.createDataFrame(rows, "item string, state string, t string").select("item", "state", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    log = lambda: runlog.log_stream(spark, f"{tmp_path}/in/*", schema)
    watched = lambda: queue.stuck_stream(log(), "item", "state", "ts", limit="2 hours", late="0 seconds")
    put(0, [("a", "start", "2024-01-01 10:00:00"), ("b", "start", "2024-01-01 10:05:00"), ("c", "start", "2024-01-01 10:06:00")])
    run(watched(), tmp_path, "stuck")
    assert spark.read.schema("item string, since timestamp, due timestamp").parquet(f"{tmp_path}/out-stuck").count() == 0
    put(1, [("b", "ok", "2024-01-01 11:00:00"), ("c", "start", "2024-01-01 11:30:00")])
    run(watched(), tmp_path, "stuck")  # from the checkpoint: a, b and c are known
    put(2, [("z", "ok", "2024-01-01 13:00:00")])
    run(watched(), tmp_path, "stuck")
    put(3, [("z", "ok", "2024-01-01 13:01:00")])
    run(watched(), tmp_path, "stuck")
    got = {(r.item, str(r.since), str(r.due)) for r in spark.read.parquet(f"{tmp_path}/out-stuck").collect()}
    assert got == {("a", "2024-01-01 10:00:00", "2024-01-01 12:00:00")}  # b ended, c began again


def test_retries_wait_give_up_and_forget(spark, tmp_path, timers):
    schema = "item string, state string"

    def step(n, rows, want):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        out = set()
        log = runlog.log_stream(spark, f"{tmp_path}/in/*", schema)
        q = queue.retries(log, "item", "state", most=3, pause_s=1, ttl_s=30).writeStream.foreachBatch(lambda df, _: out.update(tuple(r) for r in df.collect()))
        q = q.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="200 milliseconds").start()
        until = time.time() + 60
        while not want <= out and time.time() < until:
            time.sleep(0.2)
        q.stop()
        assert want <= out, out

    step(0, [("a", "error"), ("b", "error"), ("b", "error"), ("c", "ok")], {("a", 1, "wait"), ("b", 2, "wait"), ("c", 0, "done")})
    time.sleep(1)
    step(1, [("b", "error"), ("d", "error")], {("b", 3, "give up"), ("d", 1, "wait"), ("d", 1, "retry")})  # after a restart: counts go on, timers fire
    time.sleep(30)
    step(2, [("b", "error")], {("b", 1, "wait")})  # its failures are too old to count


def test_results_are_drained_in_parts(spark, tmp_path):
    schema = "id int, batch int, value string, attempt int"
    spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id int, batch int").write.parquet(f"{tmp_path}/requests")
    good, stale = (queue.BucketedTable(f"{tmp_path}/{n}", ["id"], "attempt", 4) for n in ("good", "stale"))

    def drain(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        queue.drain(runlog.log_stream(spark, f"{tmp_path}/in/*", schema), f"{tmp_path}/requests", good, stale, "id", "batch", f"{tmp_path}/check")

    drain(0, [(1, 1, "x", 1), (2, 1, "y", 1), (9, 1, "unknown", 1)])
    spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id int, batch int").write.mode("overwrite").parquet(f"{tmp_path}/requests")
    drain(1, [(2, 1, "late", 2), (2, 2, "again", 2), (3, 1, "z", 1)])
    assert {(r.id, r.value) for r in good.read(spark).collect()} == {(1, "x"), (2, "again"), (3, "z")}
    assert {(r.id, r.value) for r in stale.read(spark).collect()} == {(9, "unknown"), (2, "late")}


def test_merges_touch_their_buckets_only(spark, tmp_path):
    t = queue.BucketedTable(f"{tmp_path}/t", ["k"], "v", 8)
    with pytest.raises(ValueError):
        t.read(spark)
    df = lambda rows: spark.createDataFrame(rows, "k int, v int, x string")
    t.merge(df([(k, 1, "old") for k in range(40)]), 0)
    first = t.manifest(spark)
    assert set(first.values()) == {0} and len(first) > 4
    for _ in range(2):  # a replay merges once
        t.merge(df([(3, 2, "new"), (3, 2, "new"), (50, 1, "new")]), 1)
    second = t.manifest(spark)
    moved = {b for b, g in second.items() if g == 1}
    assert 1 <= len(moved) <= 2 and all(second[b] == 0 for b in second if b not in moved)
    rows = {r.k: (r.v, r.x) for r in t.read(spark).collect()}
    assert len(rows) == 41 and rows[3] == (2, "new") and rows[50] == (1, "new") and rows[4] == (1, "old")
    t.merge(df([]), 2)
    t.merge(df([(3, 1, "older")]), 3)
    assert {r.k: r.x for r in t.read(spark).collect()}[3] == "new"
    t.clean(spark, keep=1)
    assert len(t._generations(spark)) == 1 and t.read(spark).count() == 41
    left = {tuple(p.split("=")[-1] for p in str(f.relative_to(tmp_path)).split("/")[2:4]) for f in (tmp_path / "t/data").glob("generation=*/bucket=*")}
    assert left == {(str(g), str(b)) for b, g in t.manifest(spark).items()}
