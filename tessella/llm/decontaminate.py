"""Benchmark decontamination: pigeonhole pieces found exactly, then verified by Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, write_table

#: ASCII punctuation and control characters become spaces before runs of white space are squeezed.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalise(text: str | None) -> str:
    """Lower case, ASCII punctuation as white space, runs of white space as one space."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()).decode("utf-8")


def pattern_masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def occurs(masks: dict[str, int], m: int, text: str, budget: int) -> bool:
    """Whether some substring of ``text`` is within ``budget`` edits of the pattern (Myers 1999, one machine word of m bits)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, left = full, 0, m, len(text)
    get = masks.get
    for c in text:
        left -= 1
        eq = get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score <= budget:
                return True
        if score - left > budget:  # even a match at every character left would not do
            return False
        ph <<= 1
        pv = ((mh << 1) | (~((eq | mv) | ph) & full)) & full
        mv = ph & (eq | mv)
    return score <= budget


class Matcher:
    """Finds which items occur in a text within their error budgets; no occurrence is missed."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, pieces = {}, {}
        for item_id, text in items:
            n = len(text)
            if not n:
                continue
            budget = int(n * rate)
            if not budget:  # whole words
                text, n = f" {text} ", n + 2
            self.items.setdefault(item_id, []).append((pattern_masks(text), n, budget))
            which = len(self.items[item_id]) - 1
            for k in range(budget + 1):
                at, end = k * n // (budget + 1), (k + 1) * n // (budget + 1)
                pieces.setdefault(text[at:end], []).append((item_id, which, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), tuple(uses)))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> list[int]:
        found, tried = set(), set()
        if self.empty or not text:
            return []
        text = f" {text} "
        for last, (size, uses) in self.automaton.iter(text):
            for item_id, which, at in uses:
                if item_id in found:
                    continue
                masks, n, budget = self.items[item_id][which]
                start = last - size + 1 - at - budget
                if (item_id, which, start) in tried:
                    continue
                tried.add((item_id, which, start))
                if occurs(masks, n, text[max(0, start) : start + n + 2 * budget], budget):
                    found.add(item_id)
        return sorted(found)


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return benchmark.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))


def _blocks(items: DataFrame, block_chars: int) -> list[Callable[[], list[tuple[int, str]]]]:
    """One loader per block of about ``block_chars`` characters of the benchmark; only what is being loaded is on the driver."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))

    def load(b: int) -> list[tuple[int, str]]:
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) if n > 1 else items
        return [(r.item, normalise(r.text)) for r in part.orderBy("item", "text").collect()]

    return [partial(load, b) for b in range(n)]


def _found(rows: DataFrame, blocks, rate: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` (key, text, ...) numbered by row, and rows (number, item_ids) of those with matches, for several blocks.

    Rows are told apart by their number, which is written with them, never by an id; each block's matches are written before
    the next block is loaded.
    """
    numbered = write_table(rows.withColumn("__number", F.monotonically_increasing_id()), "decontaminate-rows")
    hits = None
    for load in blocks:
        found = numbered.select(F.col("__number").alias("id"), "__text").mapInArrow(_scan(load(), rate), "id long, item_ids array<long>")
        found = write_table(found.where(F.size("item_ids") > 0), "decontaminate-hits")
        hits = found if hits is None else hits.unionByName(found)
    return numbered, hits.groupBy("id").agg(F.flatten(F.collect_list("item_ids")).alias("item_ids")).withColumnRenamed("id", "__hit")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """Rows (id, item_ids), one per row of ``docs``: the items that occur in the whole text.

    An item of n normalised characters may differ by floor(rate * n) edits; one of its budget + 1 pieces
    then occurs unchanged, so exact piece hits miss nothing. Items too short for an error match whole words only. The benchmark is held in
    blocks of at most about ``block_chars`` characters, one after the other: that bounds what the driver and each task hold of it.
    """
    blocks = _blocks(_items(benchmark, item_col, item_text), block_chars)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__text"))
    if len(blocks) == 1:
        return rows.mapInArrow(_scan(blocks[0](), rate), f"id {dict(docs.dtypes)[id_col]}, item_ids array<long>")
    numbered, hits = _found(rows, blocks, rate)
    out = numbered.select("id", "__number").join(hits, F.col("__number") == F.col("__hit"), "left")
    return out.select("id", F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"))


def _scan(block: list[tuple[int, str]], rate: float, keep: bool = False):
    """mapInArrow body; the text is the last column. ``keep`` returns the rows without matches instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, rate)
        for batch in batches:
            ids = [matcher.find(normalise(t.as_py())) for t in batch.column(batch.num_columns - 1)]
            if keep:
                yield batch.filter(pa.array([not i for i in ids], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["id", "item_ids"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.08, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` (all its columns) in which no benchmark item occurs; see ``matches`` and ``decontaminate``."""
    blocks = _blocks(_items(benchmark, item_col, item_text), block_chars)
    inner = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner).withColumn("__text", F.col(inner[docs.columns.index(text_col)]).cast("string"))
    if len(blocks) == 1:
        return rows.mapInArrow(_scan(blocks[0](), rate, keep=True), rows.schema).drop("__text").toDF(*docs.columns)
    numbered, hits = _found(rows, blocks, rate)
    return numbered.join(hits, F.col("__number") == F.col("__hit"), "left_anti").select(*inner).toDF(*docs.columns)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows (id, contaminated, n_items, item_ids), one per row of ``docs``.

    Defined results: a null or empty text is clean; items that are null, without an id or empty after
    normalisation match nothing; an empty benchmark leaves every document clean; an item listed twice
    counts once; repeated documents and rows without an id each give a row; other columns are not read.
    """
    found = matches(docs, benchmark, **options)
    ids = F.array_sort(F.array_distinct("item_ids"))
    return found.select("id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")
