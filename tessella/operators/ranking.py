"""Scoring, ranking, fusion and grouping of search rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import fold
from tessella.functions.vectors import best_cosine
from tessella.operators.predicates import SearchFilter

SEMANTIC_WEIGHT, RRF_K, EXACT = 0.8, 60, 0.9995
SEMANTIC_CAP, LEXICAL_CAP = 100, 1000


def top(rows: DataFrame, score: str, id_col: str, n: int) -> DataFrame:
    """The n best rows by score, ties by id (planned as a distributed top-k)."""
    return rows.orderBy(F.desc(score), id_col).limit(n)


def leaderboard(rows: DataFrame, score: str, id_col: str, n: int, name: str) -> DataFrame:
    """(id, name): positions 1..n of the best rows; only n rows meet in one task."""
    best = top(rows.select(id_col, score), score, id_col, n)
    return best.select(id_col, F.row_number().over(Window.orderBy(F.desc(score), id_col)).alias(name))


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms (folded words) occur as words of the folded text; null for a null text.

    The text is folded once for all terms, also where filters repeat the expression; the pattern, which checks where the word begins and ends,
    only runs over texts that contain the term.
    """
    word = lambda folded, t: folded.contains(t) & folded.rlike(rf"(^|[^a-z0-9]){t}([^a-z0-9]|$)")
    hits = lambda folded: sum((word(folded, t).cast("int") for t in terms), F.lit(0))
    return F.get(F.transform(F.array(fold(text)), hits), F.lit(0))


def clause_match(tokens: Column, clauses: Sequence[Sequence[str]]) -> Column:
    """Any clause all of whose terms are among the tokens: terms are joined by AND, clauses by OR. The tokens are derived once, also in a filter."""

    def any_clause(words):
        hit = F.lit(False)
        for clause in clauses:
            all_ = F.lit(True)
            for t in clause:
                all_ = all_ & F.array_contains(words, t)
            hit = hit | all_
        return hit

    return F.get(F.transform(F.array(tokens), any_clause), F.lit(0))


def rrf(sem: Column, lex: Column, weight: float = SEMANTIC_WEIGHT, k: int = RRF_K) -> Column:
    """Weighted reciprocal-rank fusion; a row missing from a list gets nothing from it."""
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(k) + r), F.lit(0.0))
    return part(weight, sem) + part(round(1 - weight, 10), lex)


def fuse(semantic: DataFrame, lexical: DataFrame, id_col: str) -> DataFrame:
    """Full outer join of two leaderboards (id, sem_rank), (id, lex_rank) with the fused score."""
    return semantic.join(lexical, id_col, "full").withColumn("rrf", rrf(F.col("sem_rank"), F.col("lex_rank")))


def search(
    rows: DataFrame, vectors: DataFrame, flt: SearchFilter, variants: Sequence[Sequence[float]], terms: Sequence[str], *, threshold: float | None = None,
    groups: int = 10, passages: int = 3, mode: str = "rrf", order: str = "score", forced: Sequence[str] = (), fetch: int | None = None, id_col: str = "doc_id", group: str = "code",
    lexical: DataFrame | None = None, key_vec: str | None = None, original: Sequence[float] | None = None,
) -> DataFrame:
    """The composed search: (group, position, passage, id, cosine, rrf).

    Filters come first (``forced`` sections override the router's). Lexical hits are scored on the scan of texts, the best
    similarity over the query's variants on the scan of vectors, and only ids and scores meet. Both leaderboards are
    fused; rows below the threshold go, unless the filter picks rows by identity. ``groups`` times ``passages`` rows and
    40 more are fetched (or ``fetch``), grouped, and the groups put in ``order``.

    With ``lexical`` (id, rank), such as ``fulltext.text_ranks`` gives from an index, no text is read and its rank
    orders the lexical board. ``key_vec`` names a second vector of the rows. The vector of the ``original`` sentence
    replaces the variants for all rows if its best row among those filtered beats theirs.
    """
    if forced:
        flt = replace(flt, sections=tuple(forced))
    kept = rows.where(flt.condition())
    if lexical is None:
        hits = kept.select(id_col, group, term_hits(F.col("text"), terms).alias("hits"))
    else:
        ranks = lexical.select(F.col("id").alias(id_col), F.round("rank", 12).alias("hits"))
        hits = kept.select(id_col, group).join(ranks, id_col, "left").withColumn("hits", F.coalesce("hits", F.lit(0.0)))
    vec, key = F.col("embedding"), F.col(key_vec) if key_vec else None
    near = vectors.where("embedding IS NOT NULL").select(id_col, F.round(best_cosine(vec, key, variants), 12).alias("cosine"), *([F.round(best_cosine(vec, key, [original]), 12).alias("own")] if original is not None else []))
    scored = hits.join(near, id_col)
    if original is not None:
        best = scored.agg((F.max("own") > F.max("cosine")).alias("use_own"))
        scored = scored.crossJoin(F.broadcast(best)).withColumn("cosine", F.when(F.col("use_own"), F.col("own")).otherwise(F.col("cosine"))).drop("own", "use_own")  # one row
    fused = fuse(leaderboard(scored, "cosine", id_col, SEMANTIC_CAP, "sem_rank"), leaderboard(scored.where("hits > 0"), "hits", id_col, LEXICAL_CAP, "lex_rank"), id_col)
    out = fused.select(id_col, F.round("rrf", 15).alias("rrf")).join(scored, id_col)
    if threshold is not None and not flt.exact:
        out = out.where(F.col("cosine") >= threshold)
    best = top(out, "cosine" if mode == "cosine" else "rrf", id_col, fetch or groups * passages + 40)
    ranked = group_passages(best, group, "cosine", id_col, passages, "rrf")  # a few dozen rows from here on
    heads = ranked.where("passage = 1").select(group, F.col("cosine").alias("score"), F.col("rrf").alias("second"), F.col(id_col).alias("first_id"))
    by = [*exact_first(F.col("score"), F.col(group))[:3], F.desc("second"), F.col(group)] if order == "score" else group_order(order, group, "score", "first_id")
    heads = heads.select(group, F.row_number().over(Window.orderBy(*by)).alias("position")).where(F.col("position") <= groups)
    return ranked.join(heads, group).select(group, "position", "passage", id_col, "cosine", "rrf")


def group_order(kind: str, name: str, similarity: str, first: str) -> list[Column]:
    """Orders of groups besides that by score: by name, by similarity of the name and then by name, or as in the document."""
    return {"alphabet": [F.col(name)], "similarity": [F.desc(similarity), F.col(name)], "document": [F.col(first)]}[kind]


def filter_only(section: Column, identity: str) -> Column:
    """Aggregate: whether a result consists of identity rows, so that only the filter picked it and similarity says nothing."""
    return (F.count("*") > 0) & F.bool_and(F.coalesce(section == identity, F.lit(False)))


def read_section(rows: DataFrame, more: Column, id_col: str) -> DataFrame:
    """A whole section in document order: (..., position, truncated); truncated if the further condition ``more`` narrowed it.

    ``rows`` are one section of one product, so numbering them in one place is bounded by a document.
    """
    narrowed = rows.agg((F.count_if(F.coalesce(more, F.lit(False))) < F.count("*")).alias("truncated"))
    out = rows.where(more).withColumn("position", F.row_number().over(Window.orderBy(id_col)))
    return out.crossJoin(F.broadcast(narrowed))  # one row


def citation(section: Column, code: Column, identity: str, numbers: dict[str, str]) -> Column:
    """Where a row comes from: the registry, or a numbered section of a document."""
    number = F.lit("")
    for name, n in numbers.items():
        number = F.when(section == name, F.lit(n)).otherwise(number)
    return F.when(section == identity, F.concat(F.lit("registry, code "), code)).otherwise(F.concat(F.lit("data/"), code, F.lit("/text § "), number, F.lit(" "), section))


#: fixed values: registration states that count as valid
VALID_STATES = ("R", "B", "C", "F", "I", "K", "M", "Y")


def valid_state(state: Column) -> Column:
    return state.isin(*VALID_STATES)


def lemmatised(words: DataFrame, word: str, lemmas: DataFrame, stop: DataFrame) -> DataFrame:
    """Words through dictionaries in order: those of ``stop`` (word) go, those of ``lemmas`` (word, lemma) become their lemma, the rest stay.

    Both are tables of a language, joined as such: adaptive execution picks the kind of join from their size.
    """
    kept = words.join(stop.select(F.col("word").alias(word)), word, "left_anti")
    return kept.join(lemmas.select(F.col("word").alias(word), "lemma"), word, "left").withColumn(word, F.coalesce("lemma", word)).drop("lemma")


def variant_scores(rows: DataFrame, vec: str, key_vec: str | None, original: Sequence[float], variants: Sequence[Sequence[float]], id_col: str) -> DataFrame:
    """(id, cosine): the variants' row-wise maximum, unless the original sentence scores higher over the whole table; then the original's."""
    v, k = F.col(vec), F.col(key_vec) if key_vec else None
    both = rows.select(id_col, best_cosine(v, k, [original]).alias("own"), best_cosine(v, k, variants).alias("other"))
    best = both.agg(F.max("own").alias("max_own"), F.max("other").alias("max_other"))
    use_own = F.col("max_own") >= F.col("max_other")
    return both.crossJoin(F.broadcast(best)).select(id_col, F.when(use_own, F.col("own")).otherwise(F.col("other")).alias("cosine"))  # one row


def group_passages(rows: DataFrame, group: str, score: str, id_col: str, passages: int, second: str | None = None) -> DataFrame:
    """The best ``passages`` rows of each group, with their rank in it and the group's best score."""
    order = [F.desc(score), *([F.desc(second)] if second else []), F.col(id_col)]
    w = Window.partitionBy(group)
    ranked = rows.withColumn("passage", F.row_number().over(w.orderBy(*order))).where(F.col("passage") <= passages)
    return ranked.withColumn("group_score", F.max(score).over(w))


def exact_first(score: Column, name: Column) -> list[Column]:
    """Order of groups: exact matches by name on top, then by score."""
    exact = score >= EXACT
    return [F.desc(exact), F.when(exact, name).asc_nulls_last(), F.desc(score), name]


def relative_to(score: Column, best: Column) -> Column:
    """Share of the best score in percent; zero if the best is not positive."""
    return F.when(best > 0, F.round(score / best * 100, 4)).otherwise(F.lit(0.0))
