"""Vector similarity in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A constant vector; it is folded into the plan."""
    return F.array(*[F.lit(float(v)) for v in values])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is null."""
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def best_cosine(vec: Column, key_vec: Column | None, variants: Sequence[Sequence[float]]) -> Column:
    """Largest similarity over query variants and the row's two vectors; a missing key vector counts as -1."""
    scores = []
    for v in variants:
        scores.append(cosine(vec, vector(v)))
        if key_vec is not None:
            scores.append(F.coalesce(cosine(key_vec, vector(v)), F.lit(-1.0)))
    return F.greatest(*scores) if len(scores) > 1 else scores[0]
