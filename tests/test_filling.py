"""Batches against a sequential loop."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators.filling import filled, with_running


def loop(rows, cap, size, ceiling):
    """id -> (batch, state), taking one row after the other."""
    out, batch, tokens, n, spent, stopped = {}, 0, 0, 0, 0, False
    batches = []
    for i, w, usd, bad in rows:
        if bad:
            out[i] = (None, "fault")
            continue
        if not batches or tokens + (w or 0) > cap or n == size:
            batches.append([])
            tokens = n = 0
        batches[-1].append((i, usd or 0))
        tokens, n = tokens + (w or 0), n + 1
    for k, b in enumerate(batches, 1):
        spent += sum(u for _, u in b)
        stopped = stopped or spent > ceiling
        out |= {i: (k, "waiting" if stopped else "sent") for i, _ in b}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_filling_equals_a_loop(spark, seed):
    r = random.Random(seed)
    cap, size = r.choice([100, 7, 1000]), r.choice([5, 1000, 1])
    weights = [[60], [1, 2, 3], [0, 0, 100, 250], [None, 5, 99, 101], [100, 1], [3]][seed]
    rows = [(i, r.choice(weights), r.randint(0, 9), r.random() < 0.1) for i in range(r.choice([1, 40, 400]))]
    df = spark.createDataFrame(rows, "id long, w long, usd long, bad boolean").repartition(3)
    got = {x.id: (x.batch, x.state) for x in filled(df, "id", [], "w", cap, size, fault=F.col("bad"), cost="usd", ceiling=500, parts=5).collect()}
    assert got == loop(rows, cap, size, 500)


def test_no_batch_over_its_cap(spark):
    df = spark.createDataFrame([(i, 60) for i in range(4)], "id long, w long")
    assert sorted((x.id, x.batch) for x in filled(df, "id", [], "w", 100, 10).collect()) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert filled(df.limit(0), "id", [], "w", 100, 10).count() == 0


def test_running_over_ties(spark):
    rows = [(r, k, r % 3) for r, k in enumerate([1, 1, 1, 1, 2, 2, 9, 9, 9, 3])]
    got = {x.r: (x.position, x.before) for x in with_running(spark.createDataFrame(rows, "r int, k int, w int"), "k", ["r"], {"before": "w"}, 4).collect()}
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    assert got == {r: (i + 1, sum(x[2] for x in order[:i])) for i, (r, _, _) in enumerate(order)}
