"""Batches filled in queue order under caps on weight, rows and cost, for queues of any length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.sources.tables import discard, written

PART_ROWS = 1 << 19  #: rows of a part of the queue, about


def with_running(rows: DataFrame, key: str, ties: list[str], sums: dict[str, str], parts: int = 64) -> DataFrame:
    """Add ``position`` (from 1) in the order of the numeric ``key`` and ``ties``, and for each of ``sums`` (name to column) the total before the row.

    The key's range is cut into parts of even size by approximate quantiles. A part is summed up by itself and starts
    where those before it end, so no task sees more than a part, and only one row a part meets in one place.
    """
    cuts = sorted(set(rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.002)))
    part = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(key)))
    split = rows.withColumn("__part", part)
    totals = split.groupBy("__part").agg(F.count("*").alias("__rows"), *[F.sum(c).alias(f"__of_{n}") for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = totals.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__start_{c}") for c in ("__rows", *[f"__of_{n}" for n in sums])])
    here = Window.partitionBy("__part").orderBy(key, *ties)
    local = split.withColumn("__row", F.row_number().over(here))
    for n, c in sums.items():
        local = local.withColumn(f"__own_{n}", F.coalesce(F.sum(c).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = local.join(F.broadcast(starts), "__part").withColumn("position", (F.col("__start___rows") + F.col("__row")).cast("long"))
    out = out.withColumns({n: F.col(f"__start___of_{n}") + F.col(f"__own_{n}") for n in sums})
    return out.select(*rows.columns, "position", *sums)


def next_starts(queue: DataFrame, cap: float, size: int) -> DataFrame:
    """Rows (position, next): where a batch that starts at a row ends and the next one starts.

    ``queue`` has position, weight and before (the weight of all earlier rows). A batch takes rows while their weight is at most
    ``cap`` and their number at most ``size``; its first row it takes in any case. The first row that no longer fits
    is the one in whose stretch of weight the batch's end falls. Stretches and ends meet in buckets of one cap each, where one
    ordered pass finds them; a bucket holds about a batch of rows.
    """
    start, stop = F.col("before"), F.col("before") + F.col("weight")
    bucket = lambda x: F.floor(x / cap)
    stretch = queue.select("position", start.alias("start"), stop.alias("stop"), F.explode(F.sequence(bucket(start), bucket(stop))).alias("bucket"))
    stretch = stretch.select("bucket", F.greatest(F.col("start").cast("double"), F.col("bucket") * float(cap)).alias("at"), F.lit(0).alias("kind"), "position", "stop")
    ends = queue.select(bucket(start + cap).alias("bucket"), (start + cap).cast("double").alias("at"), F.lit(1).alias("kind"), "position", F.lit(None).cast(dict(stretch.dtypes)["stop"]).alias("stop"))
    order = Window.partitionBy("bucket").orderBy("at", "kind", "position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last(F.when(F.col("kind") == 0, F.struct(F.col("position").alias("row"), F.col("stop").alias("stop"))), ignorenulls=True).over(order)
    met = stretch.unionByName(ends).withColumn("held", held).where("kind = 1")
    over = F.when(F.col("held.stop") > F.col("at"), F.greatest(F.col("held.row"), F.col("position") + 1))  # else all that is left fits
    return met.select("position", F.least(over, F.col("position") + size).alias("next"))


def starts_of(pointers: DataFrame) -> DataFrame:
    """Rows (position, batch): the starts reached from position 1 by following (position, next), by pointer doubling.

    After k rounds the pointers reach 2^k batches ahead and the first 2^k starts are known: the rounds number the
    logarithm of the batches. A pointer past the last row ends the chain.
    """
    def ahead(found: DataFrame, jump: DataFrame, reach: int) -> DataFrame:
        onto = found.join(jump, "position").select(F.col("next").alias("position"), (F.col("batch") + reach).alias("batch"))
        return found.unionByName(onto.join(jump.select("position"), "position"))

    def twice(jump: DataFrame) -> DataFrame:
        onward = jump.select(F.col("position").alias("next"), F.col("next").alias("onward"))
        return jump.join(onward, "next", "left").select("position", F.coalesce("onward", "next").alias("next"))

    jump = written(pointers, "batch-pointers")
    found, known, reach = jump.where("position = 1").select("position", F.lit(1).cast("long").alias("batch")), 0, 1
    while True:  # two doublings a round
        before, found = found, written(ahead(ahead(found, jump, reach), twice(jump), 2 * reach), "batch-starts")
        discard(before)
        n = found.count()
        if n == known or n < 4 * reach:
            discard(jump)
            return found
        known, reach = n, reach * 4
        before, jump = jump, written(twice(twice(jump)), "batch-pointers")
        discard(before)


def in_order(rows: DataFrame, by: list[str], parts: int) -> DataFrame:
    """The rows written in order: ``__part`` numbers ranges of the order, ``__row`` (from 0) the rows of a part. Parts grow in number with the rows, not in size."""
    parts = max(parts, -(-rows.count() // PART_ROWS))
    place = F.monotonically_increasing_id()  # the partition's number, and the row's in it
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", place)
    split = ordered.withColumn("__part", F.shiftright("__at", 33).cast("int")).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    return written(split.drop("__at"), "queue")


def _weights(part: pa.Table) -> np.ndarray:
    row = np.asarray(part["__row"].combine_chunks())
    out = np.empty(len(row))
    out[row] = np.asarray(part["weight"].combine_chunks())
    return out


def _next_of(weights: np.ndarray, cap: float, size: int) -> np.ndarray:
    """For each row the one that starts the next batch if it starts one; at least their number if no row of these does."""
    total, at = np.concatenate([[0.0], np.cumsum(weights)]), np.arange(len(weights))
    over = np.searchsorted(total, total[:-1] + cap, side="right") - 1
    return np.minimum(np.maximum(over, at + 1), at + size)


def batch_starts(queue: DataFrame, cap: float, size: int) -> DataFrame:
    """Rows (__part, __row, batch): the first row of each batch, and before all rows of a part (row -1) the batch that is open there.

    ``queue`` has __part, __row (see ``in_order``) and weight. The first start in a part is among its first ``size`` rows. So each part tells, for each of
    these, the last start in it that they lead to and the number of starts on the way; with the weights at its two ends that is what
    one pass over the parts needs to find where each is entered. Then each part follows its own starts.
    """

    def ways(part: pa.Table) -> pa.Table:
        weights = _weights(part)
        n, onward = len(weights), _next_of(weights, cap, size).tolist()
        last, batches = list(range(n)), [1] * n
        for i in range(n - 1, -1, -1):
            if onward[i] < n:
                last[i], batches[i] = last[onward[i]], batches[onward[i]] + 1
        held = {"head": weights[:size], "tail": weights[-size:], "last": last[:size], "batches": batches[:size]}
        return pa.table({"__part": part["__part"][:1], "n": [n], **{k: pa.array([v], pa.list_(pa.float64() if k in ("head", "tail") else pa.int64())) for k, v in held.items()}})

    def entered(parts: pa.Table) -> pa.Table:
        rows = sorted(parts.to_pylist(), key=lambda p: p["__part"])
        out, batch, number, weight = [], 0, 0, 0.0  # the open batch, its rows and their weight
        for p in rows:
            total = np.concatenate([[0.0], np.cumsum(p["head"])])
            entry = 0 if not batch else min(int(np.searchsorted(total, cap - weight, side="right")) - 1, size - number)
            entry = max(entry, 0)  # none of these rows fits
            if entry < p["n"]:
                out.append((p["__part"], batch, entry))
                batch += p["batches"][entry]
                number = p["n"] - p["last"][entry]
                weight = float(np.sum(p["tail"][len(p["tail"]) - number :]))
            else:  # all of them are in the open batch
                out.append((p["__part"], batch, None))
                number, weight = number + p["n"], weight + float(total[-1])
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"__part": pa.array(a, pa.int32()), "batch": pa.array(b, pa.int64()), "entry": pa.array(c, pa.int64())})

    def starts(part: pa.Table, at: pa.Table) -> pa.Table:
        (at,) = at.to_pylist()
        found, i, n = [-1], at["entry"], part.num_rows
        if i is not None:
            onward = _next_of(_weights(part), cap, size).tolist()
            while i < n:
                found.append(i)
                i = onward[i]
        return pa.table({"__part": pa.array([at["__part"]] * len(found), pa.int32()), "__row": pa.array(found, pa.int64()), "batch": pa.array(range(at["batch"], at["batch"] + len(found)), pa.int64())})

    narrow = queue.select("__part", "__row", F.col("weight").cast("double").alias("weight"))
    by_part = narrow.groupBy("__part").applyInArrow(ways, "__part int, n long, head array<double>, tail array<double>, last array<long>, batches array<long>")
    places = by_part.groupBy().applyInArrow(entered, "__part int, batch long, entry long")  # a row a part, of some ``size`` numbers
    return narrow.groupBy("__part").cogroup(places.groupBy("__part")).applyInArrow(starts, "__part int, __row long, batch long")


def filled(
    rows: DataFrame, key: str, ties: list[str], weight: str, cap: float, size: int, fault: Column | None = None, cost: str | None = None, ceiling: float | None = None, parts: int = 64,
) -> DataFrame:
    """Add ``batch`` (from 1) and ``state`` to the rows of a queue, as a sequential loop would.

    Rows in order of the numeric ``key`` and ``ties`` fill a batch until the next one would pass ``cap`` in weight or ``size`` in rows;
    the next batch starts with that row. A row heavier than the cap is a batch alone. Rows with a ``fault`` take no place in any batch
    (state ``fault``). Batches are sent in order as long as the ``cost`` of all of them stays within ``ceiling`` (``sent``);
    the one that would pass it, and all after it, wait (``waiting``). Weights and costs are not negative; null
    weights and costs count as zero, and a null fault as none. No row is dropped.
    """
    bad = F.coalesce(fault, F.lit(False)) if fault is not None else F.lit(False)
    marked = rows.withColumns({"__bad": bad, "weight__": F.coalesce(F.col(weight), F.lit(0)), "cost__": F.coalesce(F.col(cost), F.lit(0)) if cost else F.lit(0)})
    queue = marked.where("NOT __bad").drop("__bad")
    placed = _by_parts(queue, [key, *ties], cap, size, parts) if size <= PART_ROWS // 8 else _by_doubling(queue, key, ties, cap, size, parts)
    money = with_running(written(placed.groupBy("batch").agg(F.sum("cost__").alias("usd")), "batch-costs"), "batch", [], {"spent": "usd"}, parts)
    if ceiling is None:
        done = placed.withColumn("state", F.lit("sent"))
    else:  # costs aren't negative, so the batches within the ceiling are the first ones
        paid = money.agg(F.coalesce(F.max(F.when(F.col("spent") + F.col("usd") <= ceiling, F.col("batch"))), F.lit(0)).alias("__paid"))
        done = placed.crossJoin(F.broadcast(paid)).withColumn("state", F.when(F.col("batch") <= F.col("__paid"), "sent").otherwise("waiting"))  # one row
    done = done.select(*rows.columns, "batch", "state")
    return done.unionByName(marked.where("__bad").select(*rows.columns, F.lit(None).cast("long").alias("batch"), F.lit("fault").alias("state")))


def _by_parts(rows: DataFrame, by: list[str], cap: float, size: int, parts: int) -> DataFrame:
    """Rows with their ``batch``: parts of the queue find their own starts, and each row takes the last one before it."""
    queue = in_order(rows, by, parts)
    starts = batch_starts(queue.select("__part", "__row", F.col("weight__").alias("weight")), cap, size)
    both = queue.unionByName(starts, allowMissingColumns=True).withColumn("__own", F.col("batch").isNull())
    before = Window.partitionBy("__part").orderBy("__row", "__own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = written(both.withColumn("batch", F.last("batch", ignorenulls=True).over(before)).where("__own").drop("__own", "__part", "__row"), "placed")
    discard(queue)
    return placed


def _by_doubling(rows: DataFrame, key: str, ties: list[str], cap: float, size: int, parts: int) -> DataFrame:
    """Rows with their ``batch``, for batches of any number of rows: every row's pointer to the next start is followed."""
    queue = written(with_running(rows, key, ties, {"before": "weight__"}, parts), "queue")
    starts = starts_of(next_starts(queue.select("position", F.col("weight__").alias("weight"), "before"), cap, size))
    ends = starts.select((F.col("batch") - 1).alias("batch"), F.col("position").alias("end"))
    last = queue.agg((F.max("position") + 1).alias("last"))
    spans = starts.join(ends, "batch", "left").crossJoin(F.broadcast(last))  # one row
    place = spans.select("batch", F.explode(F.sequence("position", F.coalesce("end", "last") - 1)).alias("position"))
    return queue.join(place, "position")
