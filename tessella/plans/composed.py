"""The composed search, its modes and orders, and queries over conversions, routing and derived texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import sql_fold, tokens
from tessella.operators import conversion as C
from tessella.operators import ranking as R
from tessella.operators import routing as RT
from tessella.operators.predicates import SearchFilter
from tessella.plans.registry import query
from tessella.plans.search import _HITS, TERMS, _q, query_vector
from tessella.sources.tables import table


def items(spark, root):
    """``documents`` as search rows: the language stands for the section, the source for the product."""
    d = table(spark, root, "documents", "doc_id", "text", "lang", "source")
    return d.select("doc_id", "text", F.col("lang").alias("section"), F.col("source").alias("code"), F.col("source").alias("name"))


def vectors(spark, root):
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


# Search ----------------------------------------------------------------------------------------------------------

_SCORED = f"""WITH r AS (SELECT doc_id, lang, source, round(greatest({_q(7)}, {_q(8)}), 12) AS cosine, {_HITS} AS hits FROM documents JOIN embeddings ON doc_id = vec_id WHERE {{}}),
s AS (SELECT doc_id, row_number() OVER (ORDER BY cosine DESC, doc_id) AS sem_rank FROM r QUALIFY sem_rank <= 100),
l AS (SELECT doc_id, row_number() OVER (ORDER BY hits DESC, doc_id) AS lex_rank FROM r WHERE hits > 0 QUALIFY lex_rank <= 1000),
f AS (SELECT doc_id, round(coalesce(0.8::DOUBLE / (60 + sem_rank), 0) + coalesce(0.2::DOUBLE / (60 + lex_rank), 0), 15) AS rrf FROM s FULL JOIN l USING (doc_id)),
j AS (SELECT doc_id, rrf, cosine, source FROM f JOIN r USING (doc_id) WHERE {{}} ORDER BY rrf DESC, doc_id LIMIT 70),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cosine DESC, rrf DESC, doc_id) AS passage FROM j),
b AS (SELECT source, cosine AS best, rrf AS best_rrf FROM p WHERE passage = 1)
"""


@query("composed_search", _SCORED.format("lang IN ('en', 'de')", "cosine >= 0.05") + """, g AS (SELECT source, best, row_number() OVER (ORDER BY best >= 0.9995 DESC, CASE WHEN best >= 0.9995 THEN source END NULLS LAST, best DESC, best_rrf DESC, source) AS position FROM b)
SELECT source AS code, position, passage, doc_id, round(cosine, 10) AS cosine FROM p JOIN g USING (source) WHERE passage <= 3 AND position <= 10""")
def composed_search(spark, root):
    """Filter, query variants, threshold, fusion, over-fetch and grouping in one."""
    out = R.search(items(spark, root), vectors(spark, root), SearchFilter(sections=("en", "de")), [query_vector(spark, root, i) for i in (7, 8)], TERMS, threshold=0.05, groups=10, passages=3)
    return out.select("code", F.col("position").cast("long").alias("position"), F.col("passage").cast("long").alias("passage"), "doc_id", F.round("cosine", 10).alias("cosine"))


@query("composed_search_exact", _SCORED.format("lang = 'fr' AND contains(lower(source), '1')", "true") + """, g AS (SELECT source, row_number() OVER (ORDER BY source) AS position FROM b)
SELECT source AS code, position, passage, doc_id, round(cosine, 10) AS cosine FROM p JOIN g USING (source) WHERE passage <= 2 AND position <= 8""")
def composed_search_exact(spark, root):
    """An exact filter switches the threshold off; a forced section overrides the router's; groups come in alphabetical order."""
    flt = SearchFilter(sections=("en",), name_part="1")
    out = R.search(items(spark, root), vectors(spark, root), flt, [query_vector(spark, root, i) for i in (7, 8)], TERMS, threshold=0.99, groups=8, passages=2, forced=("fr",), order="alphabet", fetch=70)
    return out.select("code", F.col("position").cast("long").alias("position"), F.col("passage").cast("long").alias("passage"), "doc_id", F.round("cosine", 10).alias("cosine"))


@query("whole_section", """WITH k AS (SELECT min(source) AS k FROM documents), w AS (SELECT doc_id, lang, n_chars FROM documents, k WHERE source = k AND lang = 'en'), n AS (SELECT count(*) AS whole, count(*) FILTER (WHERE n_chars >= 200) AS kept FROM w)
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position, kept < whole AS truncated FROM w, n WHERE n_chars >= 200""")
def whole_section(spark, root):
    """One product and one section: the section is read as a whole in document order; the flag tells if another filter narrowed it."""
    d = table(spark, root, "documents", "doc_id", "lang", "source", "n_chars")
    code = d.agg(F.min("source").alias("source"))
    return R.read_section(d.where("lang = 'en'").join(F.broadcast(code), "source"), F.col("n_chars") >= 200, "doc_id").select("doc_id", F.col("position").cast("long").alias("position"), "truncated")


_GROUPS = "WITH g AS (SELECT source, min(doc_id) AS first_doc, max(doc_id % 97) / 97.0::DOUBLE AS similarity FROM documents GROUP BY 1)"


@query("group_orders", _GROUPS + " SELECT source, row_number() OVER (ORDER BY source) AS alphabet, row_number() OVER (ORDER BY similarity DESC, source) AS similar_name, row_number() OVER (ORDER BY first_doc) AS document FROM g")
def group_orders(spark, root):
    """Positions of groups (some dozens of sources) in the orders that a result may have besides that by score."""
    d = table(spark, root, "documents", "doc_id", "source")
    g = d.groupBy("source").agg(F.min("doc_id").alias("first_doc"), (F.max(F.col("doc_id") % 97) / F.lit(97.0)).alias("similarity"))
    at = lambda kind, name: F.row_number().over(Window.orderBy(*R.group_order(kind, "source", "similarity", "first_doc"))).cast("long").alias(name)
    return g.select("source", at("alphabet", "alphabet"), at("similarity", "similar_name"), at("document", "document"))


@query("selected_by_filter", "SELECT source, bool_and(lang = 'en') AND count(*) > 0 AS filter_only, CASE WHEN bool_and(lang = 'en') THEN count(*) ELSE least(count(*), 10) END AS shown FROM documents GROUP BY 1")
def selected_by_filter(spark, root):
    """Results that only identity rows make up were picked by the filter: they are shown in full and by name."""
    d = table(spark, root, "documents", "source", "lang")
    only = R.filter_only(F.col("lang"), "en")
    return d.groupBy("source").agg(only.alias("filter_only"), F.when(only, F.count("*")).otherwise(F.least(F.count("*"), F.lit(10))).alias("shown"))


# Texts of search rows --------------------------------------------------------------------------------------------


@query("search_key", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, p_type) ELSE CASE WHEN p_partkey % 3 <> 0 THEN p_brand END END AS search_key FROM part")
def search_key(spark, root):
    """The key of a row; a dosing without one is found by its patient group."""
    p = table(spark, root, "part")
    key = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    return p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.coalesce(key, "p_type")).otherwise(key).alias("search_key"))


@query("context_string", "SELECT p_partkey, concat_ws(', ', p_name, CASE WHEN p_partkey % 4 <> 0 THEN p_size || ' mg' END, array_to_string(string_split(p_type, ' '), ' + ')) AS context FROM part")
def context_string(spark, root):
    """Name, strength and substances; what is missing leaves no gap."""
    strength = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.col("p_size").cast("string"), F.lit(" mg")))
    return table(spark, root, "part").select("p_partkey", F.concat_ws(", ", "p_name", strength, F.array_join(F.split("p_type", " "), " + ")).alias("context"))


@query("source_citation", "SELECT doc_id, CASE lang WHEN 'en' THEN 'registry, code ' || source ELSE 'data/' || source || '/text § ' || CASE lang WHEN 'de' THEN '4.1' WHEN 'fr' THEN '4.3' WHEN 'es' THEN '4.8' ELSE '' END || ' ' || lang END AS citation FROM documents WHERE lang IS NOT NULL")
def source_citation(spark, root):
    """Where a row comes from: the registry, or a section of a document by number and name."""
    d = table(spark, root, "documents", "doc_id", "lang", "source").where("lang IS NOT NULL")
    return d.select("doc_id", R.citation(F.col("lang"), F.col("source"), "en", {"de": "4.1", "fr": "4.3", "es": "4.8"}).alias("citation"))


@query("filter_valid_states", "SELECT o_orderkey FROM orders WHERE chr(65 + (o_orderkey % 26)::INT) IN ('R', 'B', 'C', 'F', 'I', 'K', 'M', 'Y') AND o_orderstatus = 'O'")
def filter_valid_states(spark, root):
    """Valid registration states, and on the market."""
    o = table(spark, root, "orders", "o_orderkey", "o_orderstatus")
    return o.where(R.valid_state(F.char(F.lit(65) + F.col("o_orderkey") % 26)) & (F.col("o_orderstatus") == "O")).select("o_orderkey")


@query("lemma_tokens", f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all({sql_fold('text')}, '[a-z0-9]+')) AS word FROM benchmark), stop AS (SELECT word FROM t GROUP BY 1 HAVING count(DISTINCT item_id) >= 30),
lem AS (SELECT DISTINCT word, left(word, greatest(length(word) - 2, 3)) AS lemma FROM t WHERE length(word) >= 6)
SELECT item_id, coalesce(lemma, word) AS token, count(*) AS n FROM t LEFT JOIN lem USING (word) WHERE word NOT IN (SELECT word FROM stop) GROUP BY 1, 2""")
def lemma_tokens(spark, root):
    """Words through the dictionaries in order: stop words go, known words become their lemma, others stay without accents."""
    b = table(spark, root, "benchmark", "item_id", "text")
    words = b.select("item_id", F.explode(tokens("text")).alias("word"))
    stop = words.groupBy("word").agg(F.countDistinct("item_id").alias("n")).where("n >= 30").select("word")
    lemma = words.where(F.length("word") >= 6).select("word").distinct().withColumn("lemma", F.left("word", F.greatest(F.length("word") - 2, F.lit(3))))
    return R.lemmatised(words, "word", lemma, stop).groupBy("item_id", F.col("word").alias("token")).agg(F.count("*").alias("n"))


# Routing ---------------------------------------------------------------------------------------------------------

_ANSWERS = """CASE event_id % 6 WHEN 0 THEN '{"sections": ["adverse", "nonsense"], "confidence": "High", "name": " a ", "strength": "10 mg", "freq_rank_max": 3}'
 WHEN 1 THEN '{"sections": ["dosing"], "confidence": "low", "freq_rank_max": 12}' WHEN 2 THEN '{"sections": ["dosing", "indication"], "confidence": "low", "rx": true}'
 WHEN 3 THEN 'no json' WHEN 4 THEN '{"sections": [], "name": "' || event_type || '"}' ELSE '{"sections": ["attributes"], "confidence": "high", "substance": "  ", "reimbursed": false}' END"""


@query("router_answers", f"""WITH a AS (SELECT event_id, CASE WHEN json_valid(x) THEN x END AS x FROM (SELECT event_id, {_ANSWERS} AS x FROM events)),
k AS (SELECT *, list_filter(coalesce(json_extract_string(x, '$.sections[*]'), []), lambda s: list_contains(['attributes', 'indication', 'contraindication', 'adverse', 'dosing'], s)) AS known FROM a),
c AS (SELECT *, CASE WHEN len(known) = 0 THEN 'low' ELSE coalesce(lower(json_extract_string(x, '$.confidence')), 'low') END AS confidence FROM k)
SELECT event_id, CASE WHEN len(known) = 0 OR (confidence = 'low' AND len(known) < 2) THEN 'all' ELSE array_to_string(known, '|') END AS sections, confidence, nullif(trim(json_extract_string(x, '$.name')), '') AS name,
 nullif(trim(json_extract_string(x, '$.substance')), '') AS substance, upper(replace(json_extract_string(x, '$.strength'), ' ', '')) AS strength,
 CASE WHEN json_extract_string(x, '$.freq_rank_max')::INT BETWEEN 1 AND 9 THEN json_extract_string(x, '$.freq_rank_max')::INT END AS freq_rank_max, json_extract_string(x, '$.rx')::BOOLEAN AS rx, json_extract_string(x, '$.reimbursed')::BOOLEAN AS reimbursed FROM c""")
def router_answers(spark, root):
    """Answers of a router, good and broken, as validated filters."""
    raw = [
        F.lit('{"sections": ["adverse", "nonsense"], "confidence": "High", "name": " a ", "strength": "10 mg", "freq_rank_max": 3}'), F.lit('{"sections": ["dosing"], "confidence": "low", "freq_rank_max": 12}'),
        F.lit('{"sections": ["dosing", "indication"], "confidence": "low", "rx": true}'), F.lit("no json"), F.concat(F.lit('{"sections": [], "name": "'), "event_type", F.lit('"}')),
        F.lit('{"sections": ["attributes"], "confidence": "high", "substance": "  ", "reimbursed": false}'),
    ]
    answer = raw[5]
    for i in range(5):
        answer = F.when(F.col("event_id") % 6 == i, raw[i]).otherwise(answer)
    out = table(spark, root, "events", "event_id", "event_type").select("event_id", RT.validated(answer).alias("f")).select("event_id", "f.*")
    return out.withColumn("sections", F.coalesce(F.array_join("sections", "|"), F.lit("all")))


@query("name_repair")
def name_repair(spark, root):
    """Names of the registry with two letters swapped, found again; names that are no one's stay."""
    p = table(spark, root, "part").select(F.col("p_name").alias("name"))
    w = F.split_part("name", F.lit(" "), F.lit(1))
    typo = F.concat(F.substring(w, 1, 1), F.substring(w, 3, 1), F.substring(w, 2, 1), F.substring(w, 4, 100))
    asked = p.select(typo.alias("name")).unionByName(p.select(w.alias("name"))).unionByName(p.select(F.concat(F.reverse(w), F.lit("qqq")).alias("name"))).distinct()
    return RT.repaired_names(asked, "name", p)


# Conversions -----------------------------------------------------------------------------------------------------

_LINE = "CASE turn % 4 WHEN 0 THEN '**' || turn || '.' || conv_id % 9 || '  ' || split_part(text, ' ', 1) || '**' WHEN 1 THEN '# ' || split_part(text, ' ', 1) || ':' WHEN 2 THEN '| **1 x** |' ELSE split_part(text, ' ', 1) END"


def converted(spark, root):
    """Turns of ``conversations`` as lines of a converted document, of all kinds that headings come in."""
    c, k, w = table(spark, root, "conversations"), F.col("turn") % 4, F.split_part("text", F.lit(" "), F.lit(1))
    bold = F.concat(F.lit("**"), F.col("turn").cast("string"), F.lit("."), (F.col("conv_id") % 9).cast("string"), F.lit("  "), w, F.lit("**"))
    line = F.when(k == 0, bold).when(k == 1, F.concat(F.lit("# "), w, F.lit(":"))).when(k == 2, F.lit("| **1 x** |")).otherwise(w)
    return c.select("conv_id", "turn", "text", line.alias("line"))


@query("promote_headings", f"""WITH l AS (SELECT conv_id, turn, {_LINE} AS line FROM conversations), t AS (SELECT *, trim(regexp_replace(replace(line, '*', ''), '\\s+', ' ', 'g')) AS inner_ FROM l)
SELECT conv_id, turn, CASE WHEN line LIKE '**%**' AND regexp_matches(inner_, '^[0-9]+(\\.[0-9]+)*\\.? ') THEN '## ' || inner_ ELSE line END AS line FROM t""")
def promote_headings(spark, root):
    return converted(spark, root).select("conv_id", "turn", C.promote_headings(F.col("line")).alias("line"))


@query("section_page", f"""WITH l AS (SELECT conv_id, turn, {_LINE} AS line FROM conversations), h AS (SELECT conv_id, turn, regexp_extract(trim(replace(line, '*', '')), '^([0-9]+(\\.[0-9]+)*)', 1) AS section FROM l WHERE line LIKE '**%')
SELECT conv_id, section, min(turn) AS page FROM h WHERE section <> '' GROUP BY 1, 2""")
def section_page(spark, root):
    h = converted(spark, root).where("line LIKE '**%'").select("conv_id", F.replace("line", F.lit("*"), F.lit("")).alias("heading"), "turn")
    return C.first_page(h, "conv_id", "heading", "turn")


@query("heading_page", """WITH RECURSIVE t AS MATERIALIZED (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations),
h AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, heading) AS i, heading FROM (SELECT conv_id, turn, split_part(x, ' ', 1 + turn % 2) AS heading FROM t) WHERE heading <> ''),
r(conv_id, i, cursor_, heading, page) AS (SELECT DISTINCT conv_id, 0::BIGINT, -1::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM h UNION ALL
  SELECT r.conv_id, h.i, coalesce(m.page, r.cursor_), h.heading, m.page FROM r JOIN h ON h.conv_id = r.conv_id AND h.i = r.i + 1,
  LATERAL (SELECT min(turn)::BIGINT AS page FROM t WHERE t.conv_id = r.conv_id AND turn >= r.cursor_ AND contains(lower(x), substr(lower(h.heading), 1, 40))) m)
SELECT conv_id, heading, arg_min(page, i) AS page FROM r WHERE page IS NOT NULL GROUP BY 1, 2""")
def heading_page(spark, root):
    """Turns stand for pages, a word of each turn for a heading: short words occur on many pages, and the order decides."""
    from tessella.functions.text import squeeze

    c = table(spark, root, "conversations").select("conv_id", F.col("turn").cast("long").alias("page"), squeeze("text").alias("text"))
    h = c.select("conv_id", F.col("page").alias("pos"), F.split_part("text", F.lit(" "), (F.col("page") % 2 + 1).cast("int")).alias("heading"))
    return C.heading_pages(h, c, "conv_id").select("conv_id", "heading", "page")


_PLAIN = "regexp_replace(lower(trim(regexp_replace(regexp_replace({}, '^#+', ''), '\\s+', ' ', 'g'))), '[:. ]+$', '')"


@query("false_headings", f"""WITH l AS (SELECT conv_id, turn, {_LINE} AS line FROM conversations), e AS (SELECT DISTINCT conv_id, {_PLAIN.format('line')} AS heading FROM l WHERE turn % 4 = 3)
SELECT conv_id, left(h.heading, 60) AS heading FROM (SELECT conv_id, {_PLAIN.format('line')} AS heading FROM l WHERE line LIKE '#%') h WHERE heading <> '' AND heading <> 'the' AND NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = h.conv_id AND e.heading = h.heading)""")
def false_headings(spark, root):
    c = converted(spark, root)
    return C.false_headings(c.where("line LIKE '#%'"), c.where("turn % 4 = 3"), "conv_id", "line", "the")


@query("conversion_verdict", """WITH c AS (SELECT o_custkey, CASE WHEN o_custkey % 11 <> 0 THEN count(*) FILTER (WHERE o_orderstatus <> 'P') / count(*)::DOUBLE END AS coverage, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS moved, 10 * count(*) AS words FROM orders GROUP BY 1),
r AS (SELECT *, list_filter([CASE WHEN coverage IS NULL THEN 'not found' END, CASE WHEN coverage < 0.9 THEN 'coverage' END, CASE WHEN moved >= 3 AND moved > 0.02 * words THEN 'frequencies elsewhere' END], lambda x: x IS NOT NULL) AS reasons FROM c)
SELECT o_custkey, CASE WHEN len(reasons) > 0 THEN 'suspicious' ELSE 'ok' END AS verdict, array_to_string(reasons, '|') AS reasons FROM r""")
def conversion_verdict(spark, root):
    o = table(spark, root, "orders", "o_custkey", "o_orderstatus", "o_orderpriority").groupBy("o_custkey")
    c = o.agg((F.count_if(F.col("o_orderstatus") != "P") / F.count("*")).alias("part"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("moved"), (F.count("*") * 10).alias("words"))
    verdict, reasons = C.verdict(F.when(F.col("o_custkey") % 11 != 0, F.col("part")), F.col("moved"), F.col("words"))
    return c.select("o_custkey", verdict.alias("verdict"), F.array_join(reasons, "|").alias("reasons"))


@query("section_source", """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN text END AS md, contains(text, 'th') AS has_table, CASE WHEN doc_id % 3 <> 0 THEN source ELSE '' END AS raw, lang = 'de' AS keeps FROM documents),
c AS (SELECT *, CASE WHEN coalesce(md, '') <> '' AND (keeps OR coalesce(has_table, false)) THEN 'markdown' WHEN raw <> '' THEN 'raw' WHEN coalesce(md, '') <> '' THEN 'markdown' ELSE 'none' END AS source FROM s WHERE keeps IS NOT NULL)
SELECT doc_id, source, length(CASE source WHEN 'markdown' THEN md WHEN 'raw' THEN raw ELSE '' END) AS chars FROM c""")
def section_source(spark, root):
    d = table(spark, root, "documents", "doc_id", "text", "lang", "source").where("lang IS NOT NULL")
    md, raw = F.when(F.col("doc_id") % 5 != 0, F.col("text")), F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise("")
    source, text = C.section_source(md, F.contains("text", F.lit("th")), raw, F.col("lang") == "de")
    return d.select("doc_id", source.alias("source"), F.length(text).cast("long").alias("chars"))


# Children only ---------------------------------------------------------------------------------------------------


@query("child_only", """WITH d AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'no' WHEN 'R' THEN 'yes' END AS kind, CASE WHEN l_quantity < 40 THEN (l_quantity % 20)::DOUBLE END AS lo, CASE WHEN l_quantity < 40 THEN (l_quantity % 20 + 4)::DOUBLE END AS hi, 'group ' || l_quantity::INT AS patient FROM lineitem),
p AS (SELECT * FROM d WHERE kind = 'yes'), g AS (SELECT l_orderkey, bool_or(lo IS NULL OR hi IS NULL OR hi > 18) AS adult, min(CASE WHEN lo < 12 THEN {'n': l_linenumber, 'p': patient} END) AS child FROM p GROUP BY 1)
SELECT o_orderkey, name OR (coalesce(NOT adult, false) AND child IS NOT NULL) AS child_only, CASE WHEN name THEN 'name: ' || left(o_orderpriority, 40) WHEN coalesce(NOT adult, false) AND child IS NOT NULL THEN 'doses for children only: ' || child.p ELSE '' END AS reason
FROM (SELECT o_orderkey, o_orderpriority, o_orderkey % 50 = 0 AS name FROM orders) o LEFT JOIN g ON g.l_orderkey = o_orderkey""")
def child_only(spark, root):
    """Products for children only, by their name or by their doses, with the reason (lines stand for doses, orders for products)."""
    from tessella.operators.ages import child_only as by_doses

    kind = F.when(F.col("l_returnflag") == "A", "no").when(F.col("l_returnflag") == "R", "yes")
    age = lambda more: F.when(F.col("l_quantity") < 40, F.col("l_quantity") % 20 + more)
    doses = table(spark, root, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("position"), kind.alias("kind"), age(0).alias("lo"), age(4).alias("hi"),
        F.concat(F.lit("group "), F.col("l_quantity").cast("int").cast("string")).alias("patient"),
    )
    names = table(spark, root, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, F.concat("o_orderpriority", F.lit(" junior"))).otherwise(F.col("o_orderpriority")).alias("name"))
    out = by_doses(names, doses, "o_orderkey")
    return out.withColumn("reason", F.regexp_replace("reason", " junior$", ""))


# Queue -----------------------------------------------------------------------------------------------------------


@query("pair_results", """WITH q AS (SELECT o_orderkey AS id, o_custkey % 7 AS batch FROM orders), r AS (SELECT l_orderkey AS id, l_suppkey % 7 AS batch, l_linenumber AS attempt FROM lineitem)
SELECT id, count(*) FILTER (WHERE q.batch = r.batch) AS paired, count(*) FILTER (WHERE q.batch <> r.batch) AS stale, max(CASE WHEN q.batch = r.batch THEN attempt END) AS attempt FROM q JOIN r USING (id) GROUP BY 1""")
def pair_results(spark, root):
    """Results find their request by id; those of another batch than the request is in now are stale and dropped."""
    q = table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("batch"))
    r = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 7).alias("of"), F.col("l_linenumber").alias("attempt"))
    same = F.col("batch") == F.col("of")
    return r.join(q, "id").groupBy("id").agg(F.count_if(same).alias("paired"), F.count_if(~same).alias("stale"), F.max(F.when(same, F.col("attempt"))).alias("attempt"))


@query("stuck_jobs", "WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1) SELECT user_id, state, last, last < now - INTERVAL 2 HOUR AND state NOT IN ('purchase', 'error') AS stuck FROM l, m")
def stuck_jobs(spark, root):
    """Jobs without a sign of life for two hours whose last state isn't final."""
    e = table(spark, root, "events", "event_id", "ts", "user_id", "event_type")
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", F.col("m.event_type").alias("state"), F.col("m.ts").alias("last"))
    late = F.col("last") < F.col("now") - F.expr("INTERVAL 2 HOURS")
    return last.crossJoin(F.broadcast(now)).select("user_id", "state", "last", (late & ~F.col("state").isin("purchase", "error")).alias("stuck"))  # one row
