"""Work queues, upserts and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(rows: DataFrame, key: str, ties: list, name: str, parts: int = 64) -> DataFrame:
    """Add a gapless 1-based number by the numeric column ``key`` (then ``ties``), without sorting all rows in one task.

    Approximate quantiles cut the key's range into parts of even size; each part is numbered by itself and starts where
    the row counts of the parts before it end (one count per part). The cuts are constants of the plan, so a
    part is the same however often it is computed.
    """
    cuts = sorted(set(rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.005)))
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col(key) > cut).cast("int")
    split = rows.withColumn("__part", part)
    counts = split.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    local = split.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(key, *ties)))
    return local.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")  # one row per part


def interleaved(first: Column, position: Column, every: int = 10) -> Column:
    """Place of a row when one row of the first queue precedes every ``every`` of the second: sort by it.

    ``position`` is the row's 1-based place in its own queue. Gaps appear when a queue runs out; only the order counts.
    """
    step = every + 1
    return F.when(first, (position - 1) * step + 1).otherwise(F.floor((position - 1) / every) * step + 2 + (position - 1) % every)


def batch_number(position: Column, size: int) -> Column:
    return F.floor((position - 1) / size) + 1


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row per key over both; at equal versions the new row wins."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new rows whose key isn't there yet; null keys are equal to each other."""
    o, n = old.select(*keys).distinct().alias("o"), new.alias("n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return old.unionByName(n.join(o, same, "left_anti"))


def add_wordings(dictionary: DataFrame, expr: str, wordings: list[str], most: int = 4) -> tuple[DataFrame, str | None]:
    """The dictionary with new wordings of an expression in the first places, or an error code and no change.

    Codes: ``invalid`` (an expression or wording under three letters), ``duplicate`` (already there, whatever the
    case) and ``full`` (more than ``most`` wordings).
    """
    clean = list(dict.fromkeys(" ".join(w.split()) for w in wordings if w.strip()))
    expr = " ".join(expr.lower().split())
    if not clean or any(sum(ch.isalpha() for ch in x) < 3 for x in (expr, *clean)):
        return dictionary, "invalid"
    have = [r.wording for r in dictionary.where(F.col("expr") == expr).select("wording").limit(most + 1).collect()]
    if {w.lower() for w in clean} & {w.lower() for w in have}:
        return dictionary, "duplicate"
    if len(have) + len(clean) > most:
        return dictionary, "full"
    spark = dictionary.sparkSession
    moved = dictionary.withColumn("pos", F.when(F.col("expr") == expr, F.col("pos") + len(clean)).otherwise(F.col("pos")))
    added = spark.createDataFrame([(expr, w, i, "gui") for i, w in enumerate(clean)], "expr string, wording string, pos int, source string")
    return moved.unionByName(added.select(*moved.columns), allowMissingColumns=True), None


def remove_wording(dictionary: DataFrame, expr: str, wording: str) -> tuple[DataFrame, str | None]:
    hit = (F.col("expr") == expr.lower()) & (F.lower("wording") == wording.lower())
    if dictionary.where(hit).isEmpty():
        return dictionary, "missing"
    return dictionary.where(~hit), None
