"""Queries over the positional index: lemmas of an affix dictionary, cover density, and the composed search on top of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import sql_fold
from tessella.operators import fulltext as X
from tessella.operators import lemmas as L
from tessella.operators import ranking as R
from tessella.operators.predicates import SearchFilter
from tessella.plans.composed import items
from tessella.plans.registry import query
from tessella.plans.search import _KEYED, _two, keyed, query_vector
from tessella.sources.tables import table, work_path

#: The affix rules of these queries; the stems are the words of ``benchmark``, every other one with all flags.
RULES = [("SFX", "S", True, "", "s", "[^s]"), ("SFX", "D", True, "e", "ed", "e"), ("SFX", "D", True, "", "ed", "[^e]"), ("SFX", "G", False, "", "ing", "."), ("PFX", "U", True, "", "un", ".")]
STOP = ["the", "of", "and", "der", "die", "und", "de", "la", "le"]
VARIANTS = ["that pour une", "with that", "que por una", "the of"]


def dictionaries(spark, root):
    word = L.words_of(F.col("text"))
    flags = F.when(F.length("stem") % 2 == 0, F.array(*map(F.lit, "SDGU"))).otherwise(F.array(F.lit("S")))
    stems = table(spark, root, "benchmark", "text").select(F.explode(word).alias("stem")).where(F.length("stem") >= 3).distinct().withColumn("flags", flags)
    return X.Dictionaries(spark.createDataFrame(RULES, L.RULES), stems, spark.createDataFrame([(w,) for w in STOP], "word string"))


_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_LEXEMES = f"""rules(kind, flag, cross_, strip, add, cond) AS (VALUES {", ".join(map(str, RULES))}), stop(term) AS (VALUES {", ".join(f"('{w}')" for w in STOP)}),
stems AS (SELECT stem, CASE WHEN length(stem) % 2 = 0 THEN ['S', 'D', 'G', 'U'] ELSE ['S'] END AS flags FROM (SELECT DISTINCT unnest({_WORDS.format("text")}) AS stem FROM benchmark) WHERE length(stem) >= 3),
tokens AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {_WORDS.format("text || ' ' || " + sql_fold("text"))} AS w FROM documents WHERE text IS NOT NULL)),
v AS MATERIALIZED (SELECT DISTINCT word FROM tokens),
suf AS (SELECT word, left(word, length(word) - length(add)) || strip AS lemma, flag, cross_, cond FROM v JOIN rules ON kind = 'SFX' AND ends_with(word, add) AND length(word) > length(add)),
pre AS (SELECT word, strip || substr(word, length(add) + 1) AS lemma, flag FROM v JOIN rules ON kind = 'PFX' AND starts_with(word, add) AND length(word) > length(add)),
suf1 AS (SELECT * FROM suf WHERE cond = '.' OR regexp_matches(lemma, '(' || cond || ')$')),
two AS (SELECT word, p.strip || substr(lemma, length(p.add) + 1) AS lemma, s.flag AS f1, p.flag AS f2 FROM suf1 s JOIN rules p ON s.cross_ AND p.cross_ AND p.kind = 'PFX' AND starts_with(lemma, p.add) AND length(lemma) > length(p.add)),
tried AS (SELECT word, word AS lemma, []::VARCHAR[] AS need FROM v UNION SELECT word, lemma, [flag] FROM suf1 UNION SELECT word, lemma, [flag] FROM pre UNION SELECT word, lemma, [f1, f2] FROM two),
found AS MATERIALIZED (SELECT DISTINCT word, lemma FROM tried JOIN stems ON stem = lemma WHERE list_has_all(flags, need)),
terms AS MATERIALIZED (SELECT word, term FROM (SELECT word, lemma AS term FROM found UNION ALL SELECT word, {sql_fold("word")} FROM v WHERE word NOT IN (SELECT word FROM found)) WHERE term NOT IN (SELECT term FROM stop)),
postings AS MATERIALIZED (SELECT DISTINCT doc_id, pos, term FROM tokens JOIN terms USING (word))"""


@query("lexemes", f"WITH {_LEXEMES} SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS n FROM postings GROUP BY 1")
def lexemes(spark, root):
    """Terms of all texts with accents and without, through affix rules, stems and the stop list."""
    return X.term_counts(table(spark, root, "documents", "doc_id", "text"), dictionaries(spark, root), "doc_id", "text")


_SLOTS = [("that",), ("pour",), ("une",), ("with",), ("que",), ("por",), ("una",)]
_CLAUSES = [(0,), (1,), (2,), (3, 0), (4, 5, 6)]
_RANKS = f"""{_LEXEMES}, slots(term, slot) AS (VALUES {", ".join(f"('{t}', {i})" for i, s in enumerate(_SLOTS) for t in s)}),
ev AS (SELECT doc_id, pos, list(DISTINCT slot) AS s FROM postings JOIN slots USING (term) GROUP BY 1, 2),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM ev),
l AS (SELECT *, {", ".join(f"max(CASE WHEN list_contains(s, {k}) THEN i END) OVER w AS l{k}" for k in range(len(_SLOTS)))} FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, i, pos, greatest({", ".join("CASE WHEN " + " AND ".join(f"l{k} IS NOT NULL" for k in c) + " THEN " + (f"least({', '.join(f'l{k}' for k in c)})" if len(c) > 1 else f"l{c[0]}") + " END" for c in _CLAUSES)}) AS start FROM l),
c AS (SELECT *, coalesce(max(start) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM b),
ranks AS MATERIALIZED (SELECT c.doc_id, sum(1.0::DOUBLE / (1 + (c.pos - f.pos) - (c.i - f.i))) AS rank FROM c JOIN e f ON f.doc_id = c.doc_id AND f.i = c.start WHERE c.start > c.begun GROUP BY 1)"""

_paths: dict[tuple[str, str], str] = {}


def index_of(spark, root) -> str:
    """The index of ``documents`` under ``root``, written once per session."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _paths:
        path = work_path(spark, "index")
        X.write_index(table(spark, root, "documents", "doc_id", "text"), path, dictionaries(spark, root), "doc_id", "text")
        _paths[key] = path
    return _paths[key]


@query("index_ranks", f"WITH {_RANKS} SELECT doc_id, round(rank, 9) AS rank FROM ranks")
def index_ranks(spark, root):
    """Documents that fulfil a query of several wordings, by cover density over the index's postings of its terms."""
    asked = X.text_query(spark, VARIANTS, dictionaries(spark, root))
    return X.text_ranks(spark, index_of(spark, root), asked).select(F.col("id").alias("doc_id"), F.round("rank", 9).alias("rank"))


@query("indexed_search", f"""WITH {_RANKS}, t AS ({_KEYED}),
r0 AS (SELECT d.doc_id, source, round(greatest({_two(7)}, {_two(8)}), 12) AS cosine, round({_two(9)}, 12) AS own, round(coalesce(rank, 0), 12) AS hits
  FROM documents d JOIN t ON d.doc_id = vec_id LEFT JOIN ranks ON ranks.doc_id = d.doc_id WHERE lang IN ('en', 'fr') AND embedding IS NOT NULL),
r AS (SELECT doc_id, source, hits, CASE WHEN (SELECT max(own) > max(cosine) FROM r0) THEN own ELSE cosine END AS cosine FROM r0),
s AS (SELECT doc_id, row_number() OVER (ORDER BY cosine DESC, doc_id) AS sem_rank FROM r QUALIFY sem_rank <= 100),
x AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) AS lex_rank FROM r WHERE hits > 0 QUALIFY lex_rank <= 1000),
f AS (SELECT doc_id, round(coalesce(0.8::DOUBLE / (60 + sem_rank), 0) + coalesce(0.2::DOUBLE / (60 + lex_rank), 0), 15) AS rrf FROM s FULL JOIN x USING (doc_id)),
j AS (SELECT doc_id, rrf, cosine, source FROM f JOIN r USING (doc_id) WHERE cosine >= 0.05 ORDER BY rrf DESC, doc_id LIMIT 70),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cosine DESC, rrf DESC, doc_id) AS passage FROM j),
g AS (SELECT source, row_number() OVER (ORDER BY cosine >= 0.9995 DESC, CASE WHEN cosine >= 0.9995 THEN source END NULLS LAST, cosine DESC, rrf DESC, source) AS position FROM p WHERE passage = 1)
SELECT source AS code, position, passage, doc_id, round(cosine, 10) AS cosine FROM p JOIN g USING (source) WHERE passage <= 3 AND position <= 10""")
def indexed_search(spark, root):
    """The composed search over the index: wordings as clauses, lemmas, cover density, key vectors and the original sentence."""
    ranks = X.text_ranks(spark, index_of(spark, root), X.text_query(spark, VARIANTS, dictionaries(spark, root)))
    near = keyed(spark, root).select(F.col("vec_id").alias("doc_id"), "embedding", "key_vec")
    out = R.search(
        items(spark, root), near, SearchFilter(sections=("en", "fr")), [query_vector(spark, root, i) for i in (7, 8)], [],
        threshold=0.05, groups=10, passages=3, lexical=ranks, key_vec="key_vec", original=query_vector(spark, root, 9),
    )
    return out.select("code", F.col("position").cast("long").alias("position"), F.col("passage").cast("long").alias("passage"), "doc_id", F.round("cosine", 10).alias("cosine"))
