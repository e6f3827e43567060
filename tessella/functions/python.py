"""The few functions that built-in expressions can't give, as Arrow-batched UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher, get_close_matches

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt similarity of two strings (0 to 1); null if either is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def closest_of(choices: list[str], cutoff: float):
    """The choice most similar to a string by gestalt ratio, null below ``cutoff``; a string is compared once per batch."""

    @F.pandas_udf(T.StringType())
    def closest(keys: pd.Series) -> pd.Series:
        found = {k: next(iter(get_close_matches(k, choices, 1, cutoff)), None) for k in keys.dropna().unique()}
        return keys.map(found).astype(object).where(keys.notna(), None)

    return closest


def _covers(positions: list[list[int]]) -> list[tuple[int, int]]:
    """Minimal intervals that hold every term, by one sweep over the merged positions."""
    events = sorted((p, t) for t, ps in enumerate(positions) for p in ps)
    last: dict[int, int] = {}
    out: list[tuple[int, int]] = []
    for p, t in events:
        last[t] = p
        if len(last) == len(positions):
            start = min(last.values())
            if out and out[-1][0] == start:
                continue
            out.append((start, p))
    return out


def cover_density(terms: list[str]):
    """Cover-density rank (Clarke, Cormack and Tudhope) of token arrays: the sum of 1 / length of minimal covers."""

    @F.pandas_udf(T.DoubleType())
    def rank(tokens: pd.Series) -> pd.Series:
        def one(words) -> float:
            if words is None:
                return 0.0
            at = [[i for i, w in enumerate(words) if w == t] for t in terms]
            if not all(at):
                return 0.0
            return float(sum(1.0 / (e - s + 1) for s, e in _covers(at)))

        return tokens.map(one).astype("float64")

    return rank


def repair_keys(expected: list[str], least: float = 0.7):
    """Mistyped names of JSON keys mapped to the expected ones: an array of names in, one of names out.

    A name that is expected stays; another takes the most similar expected name that is still free, if its ratio reaches ``least``.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def repair(names: pd.Series) -> pd.Series:
        def one(given):
            if given is None:
                return None
            out: list[str] = []
            for name in given:
                free = [e for e in expected if e not in out]
                ratios = [(SequenceMatcher(None, e, name).ratio(), e) for e in free]
                best = max(ratios, default=(0.0, name))
                out.append(name if name in expected or best[0] < least else best[1])
            return out

        return names.map(one)

    return repair
