"""Quality classifier: an ensemble of tree-path rules over text statistics with lasso logistic weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents

STATS = [
    "log_chars", "log_words", "mean_word", "upper", "lower", "digit", "space", "period_comma", "mark", "symbol",
    "distinct_words", "adjacent_repeats", "distinct_triples", "distinct_lines", "words_per_line", "short_words", "entropy",
]


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 period or comma, 6 other marks of sentences, 7 symbol."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if 0xD800 <= i <= 0xDFFF:
            continue
        c = chr(i)
        table[i] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".," else 6 if c in "!?;:'\"()-" else 7
    return table


def statistics(text: str | None) -> list[float]:
    """The values of STATS for one text; an empty text has zeros."""
    text = text or ""
    words = text.split()
    n, m = len(text), len(words)
    if not m:
        return [float(np.log1p(n))] + [0.0] * (len(STATS) - 1)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    share = np.bincount(_classes()[points], minlength=8) / n
    chars = np.bincount(points & 0x3FF, minlength=1024)
    p = chars[chars > 0] / n
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:]))) / (m - 2) if m > 2 else 1.0
    return [
        float(np.log1p(n)), float(np.log1p(m)), (n - share[4] * n) / m, *(float(s) for s in share[1:]),
        len(set(words)) / m, repeats / m, triples, len(set(lines)) / len(lines), m / len(lines),
        sum(len(w) <= 2 for w in words) / m, float(-(p * np.log2(p)).sum()),
    ]


def with_statistics(docs: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    """The columns ``carry`` plus one double per statistic of the whole text in ``text_col``."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [f"`{s}` double" for s in STATS])
    sent = carry if text_col in carry else [*carry, text_col]
    at = sent.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column(at)], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *(pa.array(v) for v in values.T)], names=[*carry, *STATS])

    return docs.select(*sent).mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  #: conditions (statistic, above, threshold), all of which must hold


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, prefix: str = "") -> Column:
        """The probability of label 1 as a Spark column over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            hit = F.lit(True)
            for j, above, cut in rule:
                c = F.col(prefix + STATS[j])
                hit = hit & ((c > F.lit(cut)) if above else (c <= F.lit(cut)))
            total = total + F.when(hit, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, leaf: int, bins: int = 32, rate: float = 0.3) -> list[Rule]:
    """Paths of boosted regression trees (logistic loss), from the root to every other node."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    rules: dict[Rule, None] = {}
    f = np.zeros(len(y))

    def grow(rows: np.ndarray, path: Rule, left: int, g: np.ndarray, h: np.ndarray) -> None:
        best = (1e-6, 0, 0)
        if left and len(rows) >= 2 * leaf:
            gt, ht = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                size = len(c) + 1
                gs, hs, ns = (np.bincount(binned[rows, j], w, size).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(ns < leaf) | (len(rows) - ns < leaf)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
        if path:
            rules.setdefault(tuple(sorted(path)))
        if best[0] <= 1e-6:
            f[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
            return
        _, j, k = best
        low = binned[rows, j] <= k
        for side, above in ((rows[low], False), (rows[~low], True)):
            grow(side, (*path, (j, above, float(cuts[j][k]))), left - 1, g, h)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        grow(np.arange(len(y)), (), depth, y - p, p * (1 - p))
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Weights of an L1-penalised logistic regression by accelerated proximal gradient; the intercept is free."""
    a = np.hstack([np.ones((len(z), 1)), z])
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / float(np.linalg.norm(a @ v) ** 2)
    w = np.zeros(a.shape[1])
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    look, t = w.copy(), 1.0
    for _ in range(steps):
        new = look - step * (a.T @ (1 / (1 + np.exp(-(a @ look))) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, leaf: int = 20, penalty: float = 4e-4) -> RuleModel:
    """Rules from boosted trees, weighted by lasso; only rules with a weight are kept. One class alone gives its rate."""
    if not len(y) or y.min() == y.max():
        rate = min(max((y.sum() + 1) / (len(y) + 2), 0.01), 0.99)
        return RuleModel(float(np.log(rate / (1 - rate))))
    rules = tree_rules(x, y.astype(float), trees, depth, max(2, min(leaf, len(y) // 20)))
    z = np.stack([_holds(r, x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    intercept, weights = lasso_logistic(z, y.astype(float), penalty)
    return RuleModel(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9])


def learn(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample: int) -> RuleModel:
    """Fit on the texts of at most ``sample`` labelled ids, those that hash lowest; ids with crc32 mod 5 = 0 are left out.

    ``rows`` has (id, text). The chosen ids are at most ``sample``, so they are broadcast and no text is shuffled; rows
    that share an id count once.
    """
    known = labels.where(F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    stats = with_statistics(rows.join(F.broadcast(known), "id"), ["id", "label"], "text")
    data = stats.groupBy("id", "label").agg(*[F.min(s).alias(s) for s in STATS]).toPandas().sort_values(["id", "label"])
    return fit(data[STATS].to_numpy(float), data["label"].to_numpy())


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns; see ``classify``."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner)
    id_, text = inner[docs.columns.index(id_col)], inner[docs.columns.index(text_col)]
    score = learn(rows.select(F.col(id_).alias("id"), F.col(text).alias("text")), labels, id_col, label_col, sample).score()
    return with_statistics(rows, inner, text).where(score >= threshold).select(*inner).toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """Rows (id, held_out, score, predicted), one per row of ``docs``.

    The model is learnt from at most ``sample`` labelled ids, none of them held out (crc32 of the id as text,
    mod 5 = 0), and applied to the statistics of every whole text as a Spark column expression. Defined
    results: a null or empty text has zero statistics and still a score; without labels, or with one class
    only, the score is the (smoothed) share of label 1, 0.5 without any; a null id is not held out; repeated
    rows each give a row; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    score = learn(rows, labels, id_col, label_col, sample).score()
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = with_statistics(rows, ["id"], "text").select("id", held.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnRenamed("id", "doc_id")
