"""Order statistics of groups of any size: the wanted ranks are found in a histogram, and only their buckets are sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def at_ranks(rows: DataFrame, group: str, key: str, ties: list[str], wanted: DataFrame, buckets: int = 256) -> DataFrame:
    """The rows of ``rows`` at the wanted ranks (group, rank, ...) of their groups, in order of ``key`` and ``ties`` (ranks from 1; null keys first).

    Approximate quantiles cut each group's range into buckets; counts per bucket tell exactly which bucket a rank falls
    into, and only rows of such buckets are numbered. A bucket is about a 256th of its group, or all rows of one key where more
    are equal. Null groups are one group.
    """
    g = lambda df: df.withColumn("__g", F.col(group))
    some = [i / buckets for i in range(1, buckets)]
    cuts = rows.groupBy(F.col(group).alias("__g")).agg(F.array_distinct(F.percentile_approx(F.col(key).cast("double"), some, 10_000)).alias("__cuts"))
    placed = g(rows).alias("r").join(cuts.alias("c"), F.col("r.__g").eqNullSafe(F.col("c.__g"))).select("r.*", "__cuts")
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c < F.col(key).cast("double"))))
    placed = placed.withColumn("__bucket", bucket).drop("__cuts")
    counts = placed.groupBy("__g", "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__g").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row per bucket
    counts = counts.withColumn("__before", F.coalesce(before, F.lit(0)))
    w = g(wanted).drop(group).alias("w")
    hit = w.join(counts.alias("b"), F.col("w.__g").eqNullSafe(F.col("b.__g")) & (F.col("rank") > F.col("__before")) & (F.col("rank") <= F.col("__before") + F.col("__n")))
    hit = hit.select("w.*", "__bucket", "__before")
    needed = hit.select(F.col("__g").alias("__hg"), F.col("__bucket").alias("__hb"), F.col("__before").alias("__hn")).distinct()
    inside = placed.join(needed, F.col("__g").eqNullSafe(F.col("__hg")) & (F.col("__bucket") == F.col("__hb")))
    numbered = inside.withColumn("__rank", F.col("__hn") + F.row_number().over(Window.partitionBy("__g", "__bucket").orderBy(key, *ties)))
    found = numbered.select(*rows.columns, F.col("__g").alias("__ng"), "__rank").join(hit, F.col("__ng").eqNullSafe(F.col("__g")) & (F.col("__rank") == F.col("rank")))
    return found.drop("__ng", "__g", "__rank", "__bucket", "__before")
