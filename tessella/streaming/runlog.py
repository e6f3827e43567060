"""The run log as a stream: an extension, as the pipelines this engine models have no streaming engine of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New log files under ``path`` as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(log: DataFrame, time: str, state: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per state in tumbling windows; rows later than ``late`` are left out. Batch or stream."""
    marked = log.withWatermark(time, late) if log.isStreaming else log
    g = marked.groupBy(F.window(time, width).alias("w"), state).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), state, "n")


def sliding_counts(log: DataFrame, time: str, state: str, width: str = "2 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    marked = log.withWatermark(time, late) if log.isStreaming else log
    g = marked.groupBy(F.window(time, width, slide).alias("w"), state).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), state, "n")


def sessions(log: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    marked = log.withWatermark(time, late) if log.isStreaming else log
    g = marked.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return g.select(user, F.col("w.start").alias("start"), "n")


def attempts(log: DataFrame, item: str, state: str, most: int = 3) -> DataFrame:
    """Per item: how often it failed so far, and whether it is given up. Stateful over a stream."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        failed = held.get[0] if held.exists else 0
        for pdf in batches:
            failed += int((pdf[state] == "error").sum())
        held.update((failed,))
        yield pd.DataFrame({item: [key[0]], "failed": [failed], "given_up": [failed >= most]})

    kind = dict(log.dtypes)[item]
    return log.groupBy(item).applyInPandasWithState(step, f"{item} {kind}, failed long, given_up boolean", "failed long", "update", GroupStateTimeout.NoTimeout)


def merge_into(path: str, keys: list[str], version: str):
    """A foreachBatch sink that keeps the latest row per key under ``path``; each batch writes a new generation.

    A batch that is run again after a failure writes the same generation again, so the merge happens once.
    """
    from tessella.operators.queues import upsert

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/generation={batch_id - 1}"
        where = spark._jvm.org.apache.hadoop.fs.Path(before)
        old = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        rows = upsert(spark.read.parquet(before), batch, keys, version) if old else upsert(batch.limit(0), batch, keys, version)
        rows.write.mode("overwrite").parquet(f"{path}/generation={batch_id}")

    return write
