"""Exact similarity of every row with every query, in blocks: matrix products sift, and what is near a decision is worked out in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows and queries that meet in one task; a matrix of CHUNK queries times ROWS is in memory at a time
ROWS, QUERIES, CHUNK = 16384, 8192, 128
#: sums of a matrix product, in whatever order, are nearer to the exact cosine than this
MARGIN = 1e-9
DIGITS = 12


def _rounded(x: np.ndarray) -> np.ndarray:
    """Rounded as Spark's ``round`` does: half up on the shortest decimal form."""
    values, at = np.unique(x, return_inverse=True)
    return np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP)) if np.isfinite(v) else v for v in values])[at] + 0.0


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (row numbers, matrix) of the vectors without a null; the others are in none."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(array.value_lengths().fill_null(-1))
    values = array.flatten()
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    holes = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
    whole = (lengths >= 0) & (holes[starts + np.maximum(lengths, 0)] == holes[starts])
    flat = np.asarray(values.cast(pa.float64()).fill_null(0.0))
    out = {}
    for n in np.unique(lengths[whole]):
        rows = np.flatnonzero(whole & (lengths == n))
        out[int(n)] = rows, flat[starts[rows][:, None] + np.arange(n)]
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    for d in range(m.shape[1]):
        total += m[:, d] * m[:, d]
    return np.sqrt(total)


def _exact(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded cosines of the rows i of a and j of b, summed from the first dimension to the last as ``functions.vectors.cosine`` does; NaN for a zero vector."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        total = np.zeros(len(x))
        for d in range(a.shape[1]):
            total += a[x, d] * b[y, d]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[at : at + (1 << 16)] = total / (na[x] * nb[y])
    return _rounded(out)


def _products(queries: pa.Table, rows: pa.Table) -> Iterator[tuple]:
    """For vectors of each length and chunks of the queries: (numbers of queries, of rows, approximate cosines, exact cosines by function of places in that matrix)."""
    left, right = _matrices(queries["qe"]), _matrices(rows["embedding"])
    for n in left.keys() & right.keys():
        (qi, q), (ri, r) = left[n], right[n]
        nq, nr = _norms(q), _norms(r)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            q1, r1 = q / nq[:, None], (r / nr[:, None]).T.copy()
            for at in range(0, len(qi), CHUNK):
                s = q1[at : at + CHUNK] @ r1
                yield qi[at : at + CHUNK], ri, s, lambda i, j, at=at: _exact(q, nq, r, nr, i + at, j)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table[name].combine_chunks().cast(pa.int64()))


def in_blocks(queries: DataFrame, rows: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``meet`` of blocks of the queries (query_id, qe, ...) and of the rows (vec_id, embedding, ...): every row meets every query once, in the task that holds both blocks.

    Blocks grow in number with the tables, not in size, so no task holds more than some ROWS rows and QUERIES queries. Null ids meet nothing.
    """
    queries, rows = queries.where("isnotnull(query_id)"), rows.where("isnotnull(vec_id)")
    blocks, parts = (max(1, -(-df.count() // most)) for df, most in ((queries, QUERIES), (rows, ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("__part", every(parts))
    r = rows.withColumn("__part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("__block", every(blocks))
    return q.groupBy("__block", "__part").cogroup(r.groupBy("__block", "__part")).applyInArrow(meet, schema)


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, truth, label, vec_id, s): of every block of ``rows`` (vec_id, label, embedding) the k best by cosine s (12 digits), ties by id, for each query (query_id, truth, qe).

    A query's own id is left out. As in SQL a zero vector's cosine is NaN and comes first; a missing vector's is null and comes last. Vectors of
    another length count as missing.
    """
    schema = f"query_id long, truth {dict(queries.dtypes)['truth']}, label {dict(rows.dtypes)['label']}, vec_id long, s double"

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        qid, vid = _column(q, "query_id"), _column(r, "vec_id")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        scored = np.zeros(len(qid), np.int64)

        def best(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
            """Keep the k best of each query: NaN first, then by cosine, then by id; a cosine of -inf is a missing one."""
            high = np.where(np.isnan(s), np.inf, s)
            order = np.lexsort((vid[j], -high, i))
            i, j, s = i[order], j[order], s[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            found.append((i[rank < k], j[rank < k], s[rank < k]))

        for qi, ri, s, exact in _products(q, r):
            s[~np.isfinite(s)] = np.inf
            own = qid[qi][:, None] == vid[ri][None, :] if np.intersect1d(qid[qi], vid[ri]).size else None
            if own is not None:
                s[own] = -np.inf
            top = min(k, s.shape[1])
            least = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top]
            i, j = np.nonzero((s >= (least - MARGIN)[:, None]) & (s > -np.inf))
            best(qi[i], ri[j], exact(i, j))
            scored[qi] = len(ri) - (own.sum(axis=1) if own is not None else 0)
        few = np.flatnonzero(scored < k)  # too few rows with a vector: those without one follow, by id
        by_id, used = np.argsort(vid, kind="stable") if len(few) else [], {(i, j) for a, b, _ in found for i, j in zip(a, b)} if len(few) else set()
        for n in few:
            rest = list(islice((j for j in by_id if vid[j] != qid[n] and (n, j) not in used), k - int(scored[n])))
            found.append((np.full(len(rest), n), np.array(rest, np.int64), np.full(len(rest), -np.inf)))
        i, j, s = (np.concatenate([f[x] for f in found] or [np.zeros(0)]) for x in range(3))
        i, j = i.astype(np.int64), j.astype(np.int64)
        return pa.table({"query_id": qid[i], "truth": q["truth"].take(pa.array(i)), "label": r["label"].take(pa.array(j)), "vec_id": vid[j], "s": pa.array(s, mask=np.isneginf(s))})

    return in_blocks(queries, rows, meet, schema)


def over_thresholds(queries: DataFrame, rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(query_id, pairs, kept): for each query (query_id, qe) and block of ``rows`` (vec_id, embedding) the number of pairs with another id, and how many of them have a cosine (12 digits) of each threshold or more.

    As in SQL, a zero vector's cosine is NaN and passes every threshold; a missing vector's passes none.
    """

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        qid, vid = _column(q, "query_id"), _column(r, "vec_id")
        kept = np.zeros((len(qid), len(thresholds)), np.int64)
        ids, times = np.unique(vid, return_counts=True)
        at = np.searchsorted(ids, qid).clip(0, max(0, len(ids) - 1))
        pairs = len(vid) - (np.where(ids[at] == qid, times[at], 0) if len(ids) else np.zeros(len(qid), np.int64))
        for qi, ri, s, exact in _products(q, r):
            s[~np.isfinite(s)] = np.inf
            if np.intersect1d(qid[qi], vid[ri]).size:
                s[qid[qi][:, None] == vid[ri][None, :]] = -np.inf
            for n, t in enumerate(thresholds):
                sure = s >= t + MARGIN
                kept[qi, n] += sure.sum(axis=1)
                near = (s >= t - MARGIN) ^ sure
                if near.any():
                    i, j = np.nonzero(near)
                    np.add.at(kept[:, n], qi[i], exact(i, j) >= t)
        return pa.table({"query_id": qid, "pairs": pairs, "kept": pa.FixedSizeListArray.from_arrays(pa.array(kept.ravel()), len(thresholds)).cast(pa.list_(pa.int64()))})

    return in_blocks(queries, rows, meet, "query_id long, pairs long, kept array<long>")
