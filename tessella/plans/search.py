"""Search queries over documents and their vectors."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.python import cover_density
from tessella.functions.text import index_tokens, sql_fold, tokens
from tessella.functions.vectors import best_cosine, cosine, vector
from tessella.operators import ranking as R
from tessella.operators.nearest import nearest, over_thresholds
from tessella.plans.registry import query
from tessella.sources.tables import table, written

TERMS = ["ention", "thand", "ering", "menteux", "ciones", "heit"]
_COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {}))"
_HITS = " + ".join(f"(regexp_matches({sql_fold('text')}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))::INT" for t in TERMS)


def query_vector(spark: SparkSession, root: str, vec_id: int) -> list[float]:
    """One row's vector, in the place of an encoded question."""
    return table(spark, root, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


_FUSED = f"""
WITH r AS (SELECT doc_id, lang, source, round({_COS.format(7)}, 12) AS cosine, {_HITS} AS hits
           FROM documents JOIN embeddings ON doc_id = vec_id),
s AS (SELECT doc_id, row_number() OVER (ORDER BY cosine DESC, doc_id) AS sem_rank FROM r QUALIFY sem_rank <= 100),
l AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) AS lex_rank FROM r WHERE hits > 0 QUALIFY lex_rank <= 1000),
f AS (SELECT coalesce(s.doc_id, l.doc_id) AS doc_id, sem_rank, lex_rank,
             coalesce(0.8::DOUBLE / (60 + sem_rank), 0) + coalesce(0.2::DOUBLE / (60 + lex_rank), 0) AS rrf
      FROM s FULL JOIN l ON s.doc_id = l.doc_id)
"""


def _scored(spark, root, vec_id=7):
    """(doc_id, lang, source, cosine, hits): each score on the scan of its own table, so texts and vectors aren't shuffled."""
    v = vector(query_vector(spark, root, vec_id))
    hits = table(spark, root, "documents").select("doc_id", "lang", "source", R.term_hits(F.col("text"), TERMS).alias("hits"))
    near = table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(cosine(F.col("embedding"), v), 12).alias("cosine"))
    return hits.join(near, "doc_id")


def _fused(spark, root):
    s = written(_scored(spark, root), "scored")
    f = R.fuse(R.leaderboard(s, "cosine", "doc_id", 100, "sem_rank"), R.leaderboard(s.where("hits > 0"), "hits", "doc_id", 1000, "lex_rank"), "doc_id")
    return f, s


@query("hybrid_rrf_top", _FUSED + "SELECT doc_id, round(rrf, 10) AS rrf, round(cosine, 10) AS cosine, lang FROM f JOIN r USING (doc_id) ORDER BY rrf DESC, doc_id LIMIT 20")
def hybrid_rrf_top(spark, root):
    f, s = _fused(spark, root)
    best = f.select("doc_id", F.round("rrf", 15).alias("rrf")).orderBy(F.desc("rrf"), "doc_id").limit(20)
    return best.join(s, "doc_id").select("doc_id", F.round("rrf", 10).alias("rrf"), F.round("cosine", 10).alias("cosine"), "lang")


@query("fuse_ranks", _FUSED + "SELECT doc_id, coalesce(sem_rank, 0) AS sem_rank, coalesce(lex_rank, 0) AS lex_rank, round(rrf, 10) AS rrf FROM f")
def fuse_ranks(spark, root):
    f, _ = _fused(spark, root)
    return f.select("doc_id", F.coalesce("sem_rank", F.lit(0)).cast("long").alias("sem_rank"), F.coalesce("lex_rank", F.lit(0)).cast("long").alias("lex_rank"), F.round("rrf", 10).alias("rrf"))


@query("candidates_union", _FUSED + "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM s UNION SELECT doc_id FROM l)")
def candidates_union(spark, root):
    f, s = _fused(spark, root)
    return table(spark, root, "documents", "doc_id", "lang").join(f.select("doc_id"), "doc_id", "left_semi")


@query("fuse_mode_cosine", _FUSED + "SELECT doc_id, round(cosine, 10) AS cosine FROM f JOIN r USING (doc_id) ORDER BY r.cosine DESC, doc_id LIMIT 25")
def fuse_mode_cosine(spark, root):
    f, s = _fused(spark, root)
    best = R.top(s.join(f.select("doc_id"), "doc_id", "left_semi"), "cosine", "doc_id", 25)
    return best.select("doc_id", F.round("cosine", 10).alias("cosine"))


@query("cosine_topk", f"SELECT vec_id, label, round(round({_COS.format(3)}, 12), 10) AS cosine FROM embeddings WHERE embedding IS NOT NULL ORDER BY round({_COS.format(3)}, 12) DESC, vec_id LIMIT 50")
def cosine_topk(spark, root):
    v = vector(query_vector(spark, root, 3))
    rows = table(spark, root, "embeddings").where("embedding IS NOT NULL").select("vec_id", "label", F.round(cosine(F.col("embedding"), v), 12).alias("s"))
    return R.top(rows, "s", "vec_id", 50).select("vec_id", "label", F.round("s", 10).alias("cosine"))


@query("cosine_threshold", f"SELECT vec_id, round(round({_COS.format(5)}, 12), 10) AS cosine FROM embeddings WHERE round({_COS.format(5)}, 12) >= 0.3")
def cosine_threshold(spark, root):
    v = vector(query_vector(spark, root, 5))
    rows = table(spark, root, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), v), 12).alias("s"))
    return rows.where("s >= 0.3").select("vec_id", F.round("s", 10).alias("cosine"))


_KEYED = "SELECT e.*, CASE WHEN k.vec_id % 3 <> 0 THEN k.embedding END AS key_vec FROM embeddings e LEFT JOIN embeddings k ON k.vec_id = e.vec_id + 1"


def _q(i: int, col: str = "embedding") -> str:
    return f"list_cosine_similarity({col}::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {i}))"


def _two(i: int) -> str:
    return f"greatest({_q(i)}, coalesce({_q(i, 'key_vec')}, -1))"


def keyed(spark, root):
    """Rows with a second vector, of the next row, missing for a third of them."""
    e = table(spark, root, "embeddings")
    k = e.select((F.col("vec_id") - 1).alias("vec_id"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("key_vec"))
    return e.join(k, "vec_id", "left")


@query("variant_max_cosine", f"WITH t AS ({_KEYED}) SELECT vec_id, round(greatest({_two(1)}, {_two(2)}, {_two(4)}), 10) AS cosine FROM t")
def variant_max_cosine(spark, root):
    variants = [query_vector(spark, root, i) for i in (1, 2, 4)]
    return keyed(spark, root).select("vec_id", F.round(best_cosine(F.col("embedding"), F.col("key_vec"), variants), 10).alias("cosine"))


@query("global_variant_switch", f"""WITH t AS ({_KEYED}), s AS (SELECT vec_id, {_two(9)} AS own, greatest({_two(1)}, {_two(2)}) AS other FROM t WHERE vec_id NOT IN (1, 2, 9)),
m AS (SELECT max(own) >= max(other) AS use_own FROM s)
SELECT vec_id, round(CASE WHEN use_own THEN own ELSE other END, 10) AS cosine FROM s, m""")
def global_variant_switch(spark, root):
    rows = keyed(spark, root).where("vec_id NOT IN (1, 2, 9)")
    out = R.variant_scores(rows, "embedding", "key_vec", query_vector(spark, root, 9), [query_vector(spark, root, 1), query_vector(spark, root, 2)], "vec_id")
    return out.select("vec_id", F.round("cosine", 10).alias("cosine"))


@query("clause_match", f"""WITH t AS (SELECT doc_id, regexp_extract_all({sql_fold('text')}, '[a-z0-9]+') AS w FROM documents)
SELECT doc_id FROM t WHERE (list_contains(w, 'that') AND list_contains(w, 'with')) OR list_contains(w, 'pour') OR (list_contains(w, 'que') AND list_contains(w, 'una') AND list_contains(w, 'por'))""")
def clause_match(spark, root):
    d = table(spark, root, "documents", "doc_id", "text").withColumn("w", tokens("text"))
    return d.where(R.clause_match(F.col("w"), [["that", "with"], ["pour"], ["que", "una", "por"]])).select("doc_id")


@query("token_index_folded", f"""WITH t AS (SELECT doc_id, list_sort(list_distinct(list_concat(
  list_filter(regexp_split_to_array(lower(text), '[^a-z0-9áčďéěíňóřšťúůýžäöüàâçèêëîïôùûñãõå]+'), lambda x: x <> ''),
  regexp_extract_all({sql_fold('text')}, '[a-z0-9]+')))) AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens, w[1] AS first_token, w[len(w)] AS last_token FROM t""")
def token_index_folded(spark, root):
    d = table(spark, root, "documents", "doc_id", "text").withColumn("w", index_tokens("text"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.try_element_at("w", F.lit(1)).alias("first_token"), F.try_element_at("w", F.lit(-1)).alias("last_token"))


@query("cover_density_rank")
def cover_density_rank(spark, root):
    d = table(spark, root, "documents", "doc_id", "text").where(R.term_hits(F.col("text"), ["that", "with"]) == 2)
    return d.select("doc_id", F.round(cover_density(["that", "with"])(tokens("text")), 10).alias("rank"))


@query("grouped_passages", _FUSED + """, g AS (SELECT source, doc_id, cosine, rrf, row_number() OVER (PARTITION BY source ORDER BY cosine DESC, rrf DESC, doc_id) AS passage
  FROM f JOIN r USING (doc_id)), k AS (SELECT * FROM g WHERE passage <= 3)
SELECT source, doc_id, passage, round(cosine, 10) AS cosine, round(max(cosine) OVER (PARTITION BY source), 10) AS group_score FROM k""")
def grouped_passages(spark, root):
    f, s = _fused(spark, root)
    out = R.group_passages(f.join(s, "doc_id"), "source", "cosine", "doc_id", 3, "rrf")
    return out.select("source", "doc_id", F.col("passage").cast("long").alias("passage"), F.round("cosine", 10).alias("cosine"), F.round("group_score", 10).alias("group_score"))


@query("exact_first_groups", _FUSED + """, g AS (SELECT source, max(round(CASE WHEN doc_id % 50 = 7 THEN 1 ELSE cosine END, 12)) AS score FROM r GROUP BY 1)
SELECT source, round(score, 10) AS score, row_number() OVER (ORDER BY score >= 0.9995 DESC, CASE WHEN score >= 0.9995 THEN source END NULLS LAST, score DESC, source) AS position FROM g""")
def exact_first_groups(spark, root):
    s = _scored(spark, root)
    g = s.groupBy("source").agg(F.max(F.round(F.when(F.col("doc_id") % 50 == 7, F.lit(1.0)).otherwise(F.col("cosine")), 12)).alias("score"))
    order = R.exact_first(F.col("score"), F.col("source"))
    return g.select("source", F.round("score", 10).alias("score"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))


@query("relative_score", _FUSED + "SELECT doc_id, CASE WHEN (SELECT max(cosine) FROM r) > 0 THEN round(cosine / (SELECT max(cosine) FROM r) * 100, 4) ELSE 0 END AS relative FROM r WHERE cosine > 0.1")
def relative_score(spark, root):
    s = written(_scored(spark, root).select("doc_id", "cosine"), "scored")
    best = s.agg(F.max("cosine").alias("best"))
    share = R.relative_to(F.col("cosine"), F.col("best"))
    return s.where("cosine > 0.1").crossJoin(F.broadcast(best)).select("doc_id", share.alias("relative"))  # one row


@query("empty_reason", _FUSED + """, w AS (SELECT DISTINCT lang FROM documents), c AS (SELECT w.lang, th.t AS threshold, count(r.doc_id) AS filtered, count(CASE WHEN r.cosine >= th.t THEN 1 END) AS passed
  FROM w CROSS JOIN (VALUES (0.1), (0.6), (1.1)) th(t) LEFT JOIN r ON r.lang = w.lang AND r.hits > 0 GROUP BY 1, 2)
SELECT lang, threshold::DOUBLE AS threshold, filtered, passed, CASE WHEN filtered = 0 THEN 'filter' WHEN passed = 0 THEN 'threshold' ELSE 'none' END AS reason FROM c""")
def empty_reason(spark, root):
    steps = (0.1, 0.6, 1.1)
    passed = [F.count_if(F.col("cosine") >= t).alias(f"n{i}") for i, t in enumerate(steps)]
    hit = _scored(spark, root).where("hits > 0").groupBy("lang").agg(F.count("*").alias("filtered"), *passed)  # one row per language meets the languages
    langs = table(spark, root, "documents", "lang").distinct()
    c = langs.join(hit, "lang", "left").na.fill(0, ["filtered", *[f"n{i}" for i in range(len(steps))]])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("passed")) for i, t in enumerate(steps)])).alias("t")
    c = c.select("lang", "filtered", each).select("lang", "filtered", "t.*")
    reason = F.when(F.col("filtered") == 0, "filter").when(F.col("passed") == 0, "threshold").otherwise("none")
    return c.select("lang", "threshold", "filtered", "passed", reason.alias("reason"))


@query("read_section", "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations WHERE role <> 'system'")
def read_section(spark, root):
    c = table(spark, root, "conversations").where("role <> 'system'")
    return c.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))


@query("precision_at_k", f"""WITH q AS (SELECT vec_id AS q, label AS ql, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT q, ql, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], qe::DOUBLE[]), 12) AS s FROM q CROSS JOIN embeddings e WHERE e.vec_id <> q),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS r FROM p QUALIFY r <= 5)
SELECT q AS query_id, count(*) FILTER (WHERE label = ql) AS hits, avg((label = ql)::INT)::DOUBLE AS precision_at_5, max((label = ql)::INT) AS hit FROM k GROUP BY 1""")
def precision_at_k(spark, root):
    e = table(spark, root, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"), F.col("embedding").alias("qe"))  # the stated query set: every fiftieth id
    s = nearest(q, e.select("vec_id", "label", "embedding"), 5)
    k = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id"))).where("r <= 5")
    good = (F.col("label") == F.col("truth")).cast("int")
    return k.groupBy("query_id").agg(F.sum(good).alias("hits"), F.avg(good).alias("precision_at_5"), F.max(good).alias("hit"))


@query("threshold_sweep", f"""WITH q AS (SELECT vec_id AS q, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT q, round(list_cosine_similarity(e.embedding::DOUBLE[], qe::DOUBLE[]), 12) AS s FROM q CROSS JOIN embeddings e WHERE e.vec_id <> q)
SELECT t::DOUBLE AS threshold, count(*) FILTER (WHERE s >= t) AS rows_kept, count(DISTINCT CASE WHEN s >= t THEN q END) AS queries_answered
FROM p CROSS JOIN (VALUES (0.0), (0.1), (0.2), (0.3), (0.4), (0.5), (0.6)) v(t) GROUP BY 1""")
def threshold_sweep(spark, root):
    e = table(spark, root, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    levels = [x / 10 for x in range(7)]
    by_query = over_thresholds(q, e.select("vec_id", "embedding"), levels).groupBy("query_id").agg(F.sum("pairs").alias("pairs"), *[F.sum(F.get("kept", F.lit(i))).alias(f"k{i}") for i in range(len(levels))])
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("n")) for i, t in enumerate(levels)]))
    t = by_query.where("pairs > 0").select(at.alias("t")).select("t.*")
    return t.groupBy("threshold").agg(F.sum("n").alias("rows_kept"), F.count_if(F.col("n") > 0).alias("queries_answered"))
