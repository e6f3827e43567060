"""The work queue as streams: a watchdog and retries with timers, results paired with the table of requests, and a table merged by buckets."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tessella.operators.queues import upsert

#: Timers and state of these operators need this store: set it before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def use_timers(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)


class _Watchdog(StatefulProcessor):
    """Keeps when a job started, and a timer for the time it may take."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.started = handle, handle.getValueState("started", "started long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        began = self.started.get()[0] if self.started.exists() else None
        for r in sorted(rows, key=lambda r: (r.at, r.state == "start")):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            began = r.at if r.state == "start" else None
            if began is not None:
                self.handle.registerTimer(began + self.limit_ms)
        if began is None:
            self.started.clear()
        else:
            self.started.update((began,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.started.exists():
            began = self.started.get()[0]
            self.started.clear()
            yield Row(item=key[0], since=began, due=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def stuck_stream(log: DataFrame, item: str, state: str, time: str, limit: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(item, since, due) of jobs whose ``start`` no other state followed within ``limit`` of event time.

    Every state of a job but ``start`` ends it; a new start begins anew. A job is told of once, when the watermark passes
    its time. What is kept is one number a running job.
    """
    spark = log.sparkSession
    limit_ms = int(spark.range(1).select((F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {limit}")).cast("double")).first()[0] * 1000)
    rows = log.withWatermark(time, late).select(F.col(item).alias("item"), F.col(state).alias("state"), F.unix_millis(time).alias("at"), time)
    out = rows.groupBy("item").transformWithState(_Watchdog(limit_ms), f"item {dict(log.dtypes)[item]}, since long, due long", "Append", "EventTime")
    return out.select(F.col("item").alias(item), F.timestamp_millis("since").alias("since"), F.timestamp_millis("due").alias("due"))


class _Retries(StatefulProcessor):
    """Counts an item's failures while they are younger than the time to live, and wakes it up after a pause."""

    def __init__(self, most: int, pause_ms: int, ttl_ms: int):
        self.most, self.pause_ms, self.ttl_ms = most, pause_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.failed = handle, handle.getValueState("failed", "failed int", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        failed = self.failed.get()[0] if self.failed.exists() else 0
        states = [r.state for r in rows]
        errors = states.count("error")
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if "ok" in states:
            self.failed.clear()
            yield Row(item=key[0], failed=failed + errors, action="done")
            return
        failed += errors
        self.failed.update((failed,))
        if failed >= self.most:
            yield Row(item=key[0], failed=failed, action="give up")
        elif errors:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.pause_ms)
            yield Row(item=key[0], failed=failed, action="wait")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.failed.exists():
            yield Row(item=key[0], failed=self.failed.get()[0], action="retry")

    def close(self) -> None:
        pass


def retries(log: DataFrame, item: str, state: str, most: int = 3, pause_s: float = 60, ttl_s: float = 7 * 86_400) -> DataFrame:
    """(item, failed, action) as states arrive: ``done`` after ``ok``; after ``error`` ``wait`` and, ``pause_s`` later, ``retry``, or ``give up`` at the last failure.

    Counts are forgotten ``ttl_s`` after the last state, so the store doesn't grow with all items there ever were. Pauses go by
    the clock: the stream needs a trigger by time (with ``availableNow`` it would wait for the next pause for ever).
    """
    rows = log.select(F.col(item).alias("item"), F.col(state).alias("state"))
    out = rows.groupBy("item").transformWithState(_Retries(most, int(pause_s * 1000), int(ttl_s * 1000)), f"item {dict(log.dtypes)[item]}, failed int, action string", "Update", "ProcessingTime")
    return out.withColumnRenamed("item", item)


def paired(results: DataFrame, requests: DataFrame, id_col: str, batch_col: str) -> tuple[DataFrame, DataFrame]:
    """Results (stream or not) with the request they answer, and the stale ones.

    ``requests`` is a table with the batch that each request is in now. A result of an unknown request or of another batch is
    stale: the request went out again since. Both come from one stream-static join.
    """
    now = requests.select(id_col, F.col(batch_col).alias("__now"))
    met = results.join(now, id_col, "left")
    fresh = F.coalesce(F.col(batch_col) == F.col("__now"), F.lit(False))
    return met.where(fresh).drop("__now"), met.where(~fresh).drop("__now")


class BucketedTable:
    """A table of the latest row per key, in buckets of the key's hash; a merge rewrites only the buckets that a batch touches.

    ``path``/data/generation=N/bucket=B holds files, ``path``/manifest/N says which generation each bucket is at. Readers
    take the newest manifest; a manifest appears by renaming a finished file, so they see all of a merge or nothing.
    A batch that is merged already is left alone, and one that broke off is written again.
    """

    def __init__(self, path: str, keys: list[str], version: str, buckets: int = 64):
        self.path, self.keys, self.version, self.buckets = path.rstrip("/"), keys, version, buckets

    def _files(self, spark: SparkSession):
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(spark._jsc.hadoopConfiguration()), lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")

    def _generations(self, spark: SparkSession) -> list[int]:
        fs, at = self._files(spark)
        if not fs.exists(at("manifest")):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at("manifest")) if s.getPath().getName().isdigit())

    def manifest(self, spark: SparkSession, generation: int | None = None) -> dict[int, int]:
        """Bucket -> generation of its files."""
        known = self._generations(spark)
        if not known:
            return {}
        line = spark.read.text(f"{self.path}/manifest/{known[-1] if generation is None else generation}", wholetext=True).first()[0]
        return {int(b): g for b, g in json.loads(line).items()}

    def _rows(self, spark: SparkSession, where: dict[int, int], schema) -> DataFrame | None:
        folders = [f"{self.path}/data/generation={g}/bucket={b}" for b, g in sorted(where.items())]
        return spark.read.schema(schema).parquet(*folders) if folders else None

    def read(self, spark: SparkSession) -> DataFrame:
        where = self.manifest(spark)
        if not where:
            raise ValueError(f"nothing was merged into {self.path} yet")
        b, g = next(iter(where.items()))
        return self._rows(spark, where, spark.read.parquet(f"{self.path}/data/generation={g}/bucket={b}").schema)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch: a newer version wins, at equal ones the batch; can be given to ``foreachBatch``."""
        spark = batch.sparkSession
        known = self._generations(spark)
        if known and batch_id <= known[-1]:
            return
        now = self.manifest(spark)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # at most the number of buckets
        if touched:
            old = self._rows(spark, {b: now[b] for b in touched if b in now}, batch.schema)
            rows = upsert(batch.limit(0) if old is None else old, batch, self.keys, self.version)
            rows.withColumn("bucket", bucket).repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/generation={batch_id}")
        fs, at = self._files(spark)
        draft = at(f"manifest/.{batch_id}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(now | dict.fromkeys(touched, batch_id)).encode()))
        out.close()
        if not fs.rename(draft, at(f"manifest/{batch_id}")):
            raise RuntimeError(f"manifest {batch_id} of {self.path} can't be put in place")

    def clean(self, spark: SparkSession, keep: int = 2) -> None:
        """Delete the manifests before the last ``keep``, and files that no manifest left names."""
        fs, at = self._files(spark)
        known = self._generations(spark)
        for g in known[:-keep]:
            fs.delete(at(f"manifest/{g}"), False)
        used = {(b, g) for k in known[-keep:] for b, g in self.manifest(spark, k).items()}
        for folder in fs.listStatus(at("data")):
            g = int(folder.getPath().getName().split("=")[1])
            held = [s.getPath() for s in fs.listStatus(folder.getPath()) if s.getPath().getName().startswith("bucket=")]
            gone = [p for p in held if (int(p.getName().split("=")[1]), g) not in used]
            for p in [folder.getPath()] if len(gone) == len(held) and g <= known[-1] else gone:
                fs.delete(p, True)


def drain(results: DataFrame, requests_path: str, out: BucketedTable, stale: BucketedTable, id_col: str, batch_col: str, checkpoint: str, timeout_s: int | None = None) -> None:
    """Take all results that are there: pair each micro-batch with the requests as they are then, and merge both kinds into their tables.

    Run again it goes on where the checkpoint ends; a micro-batch that is repeated after a failure merges once.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        good, old = paired(batch, batch.sparkSession.read.parquet(requests_path), id_col, batch_col)
        out.merge(good, batch_id)
        stale.merge(old, batch_id)

    q = results.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
