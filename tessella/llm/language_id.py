"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import documents

UNKNOWN = "und"
_BITS, _SPACE = 21, 32
_CHUNK = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((not 0xD800 <= i <= 0xDFFF and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_codes(text: str) -> np.ndarray:
    """All letter 1-, 2- and 3-grams of the lower-cased text with words padded by one space, as integers."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    x = np.where(_letters()[points], points, _SPACE).astype(np.int64)
    x = np.concatenate([[_SPACE], x, [_SPACE]])
    x = x[np.concatenate([[True], (x[1:] != _SPACE) | (x[:-1] != _SPACE)])]
    pairs = (x[:-1] << _BITS) | x[1:]
    triples = ((pairs[:-1] << _BITS) | x[2:])[x[1:-1] != _SPACE]
    return np.concatenate([x[x != _SPACE], pairs, triples])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a text of any length and their counts."""
    if len(text) <= _CHUNK:
        return np.unique(gram_codes(text), return_counts=True)
    parts, at = [], 0
    while at < len(text):  # cut a long text between words
        end = min(at + _CHUNK, len(text))
        if end < len(text):
            end = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 or end
            end = end if end > at else min(at + _CHUNK, len(text))
        parts.append(np.unique(gram_codes(text[at:end]), return_counts=True))
        at = end
    return _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent grams, best first; ties by code."""
    if len(codes) > 4 * size:  # only grams that can get a rank need sorting
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:size]]


def train_profiles(docs: DataFrame, text_col: str, lang_col: str, size: int) -> dict[str, list[int]]:
    """The ``size`` top grams of every language, counted over all rows of ``docs`` (languages x size values in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list] = {}

        def add(lang: str, texts: list[str]) -> None:
            parts = totals.setdefault(lang, [])
            parts.append(gram_counts("\n".join(texts)))
            if len(parts) > 16:
                totals[lang] = [_merged(parts)]

        for batch in batches:
            waiting: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts = waiting.setdefault(lang, [])
                texts.append(text)
                if len(texts) > 1 and sum(map(len, texts[-64:])) > _CHUNK // 2 or len(texts) >= 64:
                    add(lang, waiting.pop(lang))
            for lang, texts in waiting.items():
                add(lang, texts)
        for lang, parts in totals.items():
            codes, counts = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], carry: list[str], text_col: str, size: int) -> DataFrame:
    """The columns ``carry`` plus (lang_pred, score): the profile nearest to the text's own ranking."""
    langs = sorted(profiles)
    tables = []
    for lang in langs:
        codes = np.array(profiles[lang], np.int64)
        order = np.argsort(codes)
        tables.append((codes[order], order))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", lang_pred string, score double"

    def judge(text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text) if text else ((), ())
        if not len(codes) or codes[-1] == _SPACE << _BITS | _SPACE or not langs:
            return UNKNOWN, 0.0
        mine = ranked(codes, counts, size)
        places, best = np.arange(len(mine)), None
        for lang, (known, rank) in zip(langs, tables):
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            away = int(np.where(known[at] == mine, np.minimum(np.abs(rank[at] - places), size), size).sum())
            if best is None or away < best[0]:
                best = away, lang
        return best[1], 1.0 - best[0] / (size * len(mine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(len(carry))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*carry, "lang_pred", "score"],
            )

    return docs.select(*carry, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 400) -> DataFrame:
    """Rows (id, held_out, lang_pred, score), one per row of ``docs``.

    A fourth of the ids (crc32 of the id as text, mod 4 = 2) is held out of training. The score is one minus
    the out-of-place distance over its largest possible value. Defined results: a text that is null,
    empty or without letters is ``und`` with score 0; equal distances go to the first language in order;
    rows with a null language are not learnt from; a null id is not held out; without any training row
    every text is ``und``; repeated rows each give a row; other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    profiles = train_profiles(rows.where(~F.col("held_out")), "text", "lang", size)
    return predict(rows.select("id", "held_out", "text"), profiles, ["id", "held_out"], "text", size)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
