"""Queries that read names, questions and free values: patterns, fragments, ages, vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.python import repair_keys
from tessella.functions.text import SOUNDS, fold, lay_form, phonetic, sql_fold, strength, term_key
from tessella.operators import normalize as N
from tessella.operators import predicates as P
from tessella.operators import understanding as U
from tessella.operators.similarity import occurrences, similar_pairs
from tessella.plans.registry import query
from tessella.sources.tables import table


def sql_phonetic(c: str) -> str:
    out = sql_fold(c)
    for a, b in SOUNDS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _text(s: str) -> str:
    return s.replace("'", "''")


# Filters ---------------------------------------------------------------------------------------------------------

_REG = """WITH reg AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_size || ' mg' AS strength,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 3 = 1 END AS rx, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_size / 2.0)::DOUBLE END AS age_from,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 5 < 3 END AS for_children, p_partkey % 7 = 0 AS children_only,
  CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 2 = 0 END AS representative FROM part) """


def registry(spark, root):
    """``part`` as a registry with three-valued flags."""
    k = F.col("p_partkey")
    return table(spark, root, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", F.concat(F.col("p_size").cast("string"), F.lit(" mg")).alias("strength"),
        F.when(k % 3 != 0, k % 3 == 1).alias("rx"), F.when(k % 4 != 0, F.col("p_size") / 2.0).alias("age_from"),
        F.when(k % 5 != 0, k % 5 < 3).alias("for_children"), (k % 7 == 0).alias("children_only"), F.when(k % 6 != 0, k % 2 == 0).alias("representative"),
    )


@query("filter_children", _REG + "SELECT p_partkey FROM reg WHERE for_children IS TRUE AND (age_from IS NULL OR age_from < 18)")
def filter_children(spark, root):
    return registry(spark, root).where(P.for_children(F.col("for_children"), F.col("age_from"))).select("p_partkey")


@query("filter_adults", _REG + "SELECT p_partkey FROM reg WHERE children_only IS NOT TRUE AND (age_from >= 12 OR (age_from IS NULL AND for_children IS NOT TRUE))")
def filter_adults(spark, root):
    return registry(spark, root).where(P.for_adults(F.col("children_only"), F.col("age_from"), F.col("for_children"))).select("p_partkey")


@query("filter_tristate", "SELECT doc_id, quality = 1 AS good, toxic = 1 AS toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE (quality = 1) AND coalesce(toxic = 0, true)")
def filter_tristate(spark, root):
    d = table(spark, root, "documents", "doc_id").join(table(spark, root, "labels"), "doc_id", "left")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return d.where(good & P.representative(F.col("toxic") == 0)).select("doc_id", good.alias("good"), toxic.alias("toxic"))


@query("filter_registry", _REG + """SELECT p_partkey, p_name FROM reg WHERE rx = true AND upper(replace(strength, ' ', '')) IN ('7MG') AND coalesce(representative, true)
   OR (p_type LIKE 'E%' AND age_from <= 6 AND p_brand = 'Brand#11') OR contains(lower(p_name), 'blue')""")
def filter_registry(spark, root):
    r = registry(spark, root)
    first = (F.col("rx") == F.lit(True)) & (strength("strength") == "7MG") & P.representative(F.col("representative"))
    second = F.startswith("p_type", F.lit("E")) & (F.col("age_from") <= 6) & (F.col("p_brand") == "Brand#11")
    return r.where(first | second | P.contains_text(F.col("p_name"), "blue")).select("p_partkey", "p_name")


@query("filter_prefix", "SELECT p_partkey, p_brand, p_type FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_size IN (1, 2, 3, 5, 8)")
def filter_prefix(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_brand", "p_type", "p_size")
    return p.where(F.col("p_brand").startswith("Brand#1") & F.col("p_size").isin(1, 2, 3, 5, 8)).select("p_partkey", "p_brand", "p_type")


@query("filter_array_any", "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 're'))) > 0")
def filter_array_any(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_name")
    return p.where(F.exists(F.split("p_name", " "), lambda x: P.contains_text(x, "re"))).select("p_partkey")


@query("filter_json_attr", "SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '30'")
def filter_json_attr(spark, root):
    return table(spark, root, "events").where(F.get_json_object("props", "$.k") == "30").select("event_id", "event_type")


_RANK = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 9 END"


def event_rank():
    ranks = {"purchase": 1, "signup": 2, "click": 3, "view": 4}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("event_type")), F.lit(9))


@query("filter_rank_max", f"SELECT event_id, event_type, {_RANK} AS freq_rank FROM events WHERE {_RANK} <= 3")
def filter_rank_max(spark, root):
    return table(spark, root, "events").select("event_id", "event_type", event_rank().alias("freq_rank")).where("freq_rank <= 3")


@query("paged_listing", "SELECT p_partkey, p_name, p_retailprice FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC NULLS LAST, p_name, p_partkey) AS r FROM part) WHERE r BETWEEN 101 AND 150")
def paged_listing(spark, root):
    p = table(spark, root, "part", "p_partkey", "p_name", "p_retailprice")
    return p.orderBy(F.desc_nulls_last("p_retailprice"), "p_name", "p_partkey").offset(100).limit(50)


# Names -----------------------------------------------------------------------------------------------------------

_NAME_Q = "CASE p_partkey % 6 WHEN 0 THEN 'lék začíná na ' || split_part(p_name, ' ', 1) || ' na rýmu' WHEN 1 THEN 'Lék obsahuje „' || substr(p_name, 2, 3) || '“' WHEN 2 THEN 'lék končí na ' || right(p_name, 4) WHEN 3 THEN 'lék začíná ' || substr(p_name, 1, 2) WHEN 4 THEN 'něco na rýmu ' || p_name ELSE 'léky přibližně ' || split_part(p_name, ' ', 2) END"


def name_questions(spark, root):
    """Questions with name patterns, made of the names in ``part``."""
    n, k = F.col("p_name"), F.col("p_partkey") % 6
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    q = (
        F.when(k == 0, cat("lék začíná na ", F.split_part(n, F.lit(" "), F.lit(1)), " na rýmu")).when(k == 1, cat("Lék obsahuje „", F.substring(n, 2, 3), "“"))
        .when(k == 2, cat("lék končí na ", F.right(n, F.lit(4)))).when(k == 3, cat("lék začíná ", F.substring(n, 1, 2)))
        .when(k == 4, cat("něco na rýmu ", n)).otherwise(cat("léky přibližně ", F.split_part(n, F.lit(" "), F.lit(2))))
    )
    return table(spark, root, "part", "p_partkey", "p_name").select("p_partkey", "p_name", q.alias("q"))


@query("name_pattern_of_question", f"""WITH t AS (SELECT p_partkey, {sql_fold(_NAME_Q)} AS q FROM part), w AS (SELECT p_partkey,
  nullif(regexp_extract(q, '{_text(U.NAME_PATTERN)}', 1), '') AS k, regexp_replace(nullif(regexp_extract(q, '{_text(U.NAME_PATTERN)}', 2), ''), '^[„“"''*…]+|[„“"''*…]+$', '', 'g') AS pattern FROM t)
SELECT p_partkey, CASE WHEN k LIKE 'zac%' THEN 'starts' WHEN k LIKE 'obs%' THEN 'contains' WHEN k LIKE 'kon%' THEN 'ends' WHEN k LIKE 'pri%' THEN 'about' END AS kind, pattern, length(pattern) >= 3 AS valid FROM w""")
def name_pattern_of_question(spark, root):
    kind, text, valid = U.name_pattern(F.col("q"))
    return name_questions(spark, root).select("p_partkey", kind.alias("kind"), text.alias("pattern"), valid.alias("valid"))


@query("name_pattern_filters", f"SELECT p_partkey, p_name, starts_with({sql_fold('p_name')}, 'blu') AS starts, contains({sql_fold('p_name')}, 'een') AS has, regexp_matches({sql_fold('p_name')}, 'er([^a-z0-9]|$)') AS ends FROM part")
def name_pattern_filters(spark, root):
    n = F.col("p_name")
    return table(spark, root, "part").select("p_partkey", "p_name", P.name_matches(n, "starts", "blu").alias("starts"), P.name_matches(n, "contains", "een").alias("has"), P.name_matches(n, "ends", "er").alias("ends"))


@query("phonetic_key", f"SELECT p_partkey, {sql_phonetic('p_name')} AS sound FROM part")
def phonetic_key(spark, root):
    return table(spark, root, "part").select("p_partkey", phonetic("p_name").alias("sound"))


@query("name_fragments", f"""WITH w AS (SELECT p_partkey AS id, regexp_extract_all({sql_phonetic("p_name || ' ' || p_type")}, '[a-z0-9]+') AS w FROM part),
f AS (SELECT id, unnest(list_distinct(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]), [array_to_string(w, '')])))) AS fragment FROM w)
SELECT fragment, id FROM f WHERE length(fragment) >= 3""")
def name_fragments(spark, root):
    p = table(spark, root, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("n"))
    return U.name_fragments(p, "p_partkey", "n").select("fragment", "id")


@query("fuzzy_names")
def fuzzy_names(spark, root):
    """Distinct name words similar to misspelt ones, among words of close length."""
    words = table(spark, root, "part").select(F.explode(F.regexp_extract_all(phonetic("p_name"), F.lit("[a-z0-9]+"), F.lit(0))).alias("word")).distinct()
    asked = words.where(F.length("word") >= 4).select(F.concat(F.substring("word", 1, 2), F.lit("e"), F.substring("word", 3, 1000)).alias("q"))
    near = similar_pairs(asked, "q", words, "word", 0.75).select(F.col("left").alias("q"), F.col("right").alias("word"), F.round("ratio", 10).alias("ratio"))
    return near.where(U.length_band(F.col("word"), F.col("q")))


@query("typo_anti_join", "SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w NOT IN (SELECT split_part(p_name, ' ', 1) FROM part WHERE p_size > 45)")
def typo_anti_join(spark, root):
    p = table(spark, root, "part", "p_name", "p_size")
    words = p.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.join(p.where("p_size > 45").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")), "word", "left_anti")


# Dictionaries ----------------------------------------------------------------------------------------------------

_DICT = "VALUES ('ention', 'attention please', 0), ('ention', 'intention', 1), ('the er', 'their errors', 0), ('er', 'error', 0), ('er', 'her', 1), ('er', 'attention please', 2)"


def small_dictionary(spark):
    rows = [("ention", "attention please", 0), ("ention", "intention", 1), ("the er", "their errors", 0), ("er", "error", 0), ("er", "her", 1), ("er", "attention please", 2)]
    return spark.createDataFrame(rows, "expr string, wording string, pos int")


_EXPAND = f"""WITH d(expr, wording, pos) AS ({_DICT}), q AS (SELECT item_id, text, regexp_extract_all({sql_fold('text')}, '[a-z0-9]+') AS w FROM benchmark),
k AS (SELECT *, regexp_extract_all(expr, '[a-z0-9]+') AS k FROM d),
h AS (SELECT item_id, text, expr, wording, pos FROM q JOIN k ON len(list_filter(range(1, greatest(len(w) - len(k) + 1, 0) + 1), lambda i: len(list_filter(range(1, len(k) + 1), lambda j: starts_with(w[i + j - 1], k[j]))) = len(k))) > 0),
f AS (SELECT item_id, list(wording ORDER BY -length(expr), expr, pos, wording) AS ws FROM h GROUP BY 1),
u AS (SELECT q.item_id, list_concat([text], coalesce(ws, [])) AS v FROM q LEFT JOIN f USING (item_id)),
x AS (SELECT item_id, list_filter(v, lambda x, i: list_position(v, x) = i)[1:5] AS v FROM u)
SELECT item_id, len(v) AS n, array_to_string(v[2:], '|') AS added FROM x"""


@query("expand_query", _EXPAND)
def expand_query(spark, root):
    out = U.expand(table(spark, root, "benchmark", "item_id", "text"), "item_id", "text", small_dictionary(spark))
    return out.select("item_id", F.size("variants").cast("long").alias("n"), F.array_join(F.slice("variants", 2, 4), "|").alias("added"))


_MAP = "VALUES ('ECONOMY', 'Brand#1'), ('PROMO', 'Brand#2'), ('STANDARD', 'Brand#3'), ('SMALL', 'Brand#4')"


@query("safety_net", f"WITH m(term, prefix) AS ({_MAP}) SELECT c.c_custkey, m.prefix, count(p.p_partkey) AS n FROM customer c JOIN m ON contains(upper(c.c_mktsegment || ' economy promo'), m.term) JOIN part p ON starts_with(p.p_brand, m.prefix) GROUP BY 1, 2")
def safety_net(spark, root):
    """Class prefixes whose terms occur in the question; their rows are counted apart from what search itself finds."""
    m = spark.createDataFrame([("ECONOMY", "Brand#1"), ("PROMO", "Brand#2"), ("STANDARD", "Brand#3"), ("SMALL", "Brand#4")], "term string, prefix string")
    q = table(spark, root, "customer").select("c_custkey", F.upper(F.concat("c_mktsegment", F.lit(" economy promo"))).alias("q"))
    met = occurrences(m, "term", q, "q").select(F.col("part").alias("term"), F.col("whole").alias("q"))
    hit = q.join(met, "q").join(m, "term")
    parts = table(spark, root, "part").select(F.substring("p_brand", 1, 7).alias("prefix"), "p_partkey").groupBy("prefix").agg(F.count("*").alias("n"))
    return hit.join(parts, "prefix").select("c_custkey", "prefix", "n")


@query("safety_net_if_empty", f"""WITH m(term, prefix) AS ({_MAP}), q AS (SELECT c_custkey, upper(c_mktsegment || ' economy') AS q, c_nationkey FROM customer),
h AS (SELECT c_custkey, count(p_partkey) AS n FROM q LEFT JOIN part ON p_size = c_nationkey AND p_size % 2 = 0 GROUP BY 1)
SELECT q.c_custkey, m.prefix, count(*) AS n FROM q JOIN h ON h.c_custkey = q.c_custkey AND h.n = 0 JOIN m ON contains(q.q, m.term) JOIN part p ON starts_with(p.p_brand, m.prefix) AND p.p_size % 2 = 0 GROUP BY 1, 2""")
def safety_net_if_empty(spark, root):
    """Questions that found nothing get the classes that their words name, under the same filter as the search (here: even sizes)."""
    m = spark.createDataFrame([("ECONOMY", "Brand#1"), ("PROMO", "Brand#2"), ("STANDARD", "Brand#3"), ("SMALL", "Brand#4")], "term string, prefix string")
    q = table(spark, root, "customer").select("c_custkey", F.upper(F.concat("c_mktsegment", F.lit(" economy"))).alias("q"), "c_nationkey")
    kept = table(spark, root, "part", "p_partkey", "p_size", "p_brand").where("p_size % 2 = 0")
    found = q.join(kept.select(F.col("p_size").cast("long").alias("c_nationkey")).distinct(), "c_nationkey").select("c_custkey")
    classes = kept.select(F.substring("p_brand", 1, 7).alias("prefix"))
    return U.safety_net(q, "c_custkey", "q", found, m, classes).groupBy("c_custkey", "prefix").agg(F.sum("n").alias("n"))


@query("dictionary_override", """WITH t AS (SELECT p_partkey, 'léčba  ' || upper(p_name) || '.' AS term, 'Při ' || p_type || '.' AS model FROM part),
d AS (SELECT lower(p_name) AS k, min(p_brand) AS lay FROM part WHERE p_size < 10 GROUP BY 1),
n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(term, '\\s+', ' ', 'g'))), '[.,;:]+$', ''), '^((léčba|léčení|terapie|při|lecba|leceni|pri) )+', '')) AS k,
  trim(regexp_replace(regexp_replace(trim(regexp_replace(model, '\\s+', ' ', 'g')), '^(Při|při|Pri|pri) ', ''), '\\.+$', '')) AS own FROM t)
SELECT p_partkey, n.k AS term_key, coalesce(lay, own) AS lay, lay IS NOT NULL AS from_dictionary FROM n LEFT JOIN d USING (k)""")
def dictionary_override(spark, root):
    p = table(spark, root, "part")
    t = p.select("p_partkey", term_key(F.concat(F.lit("léčba  "), F.upper("p_name"), F.lit("."))).alias("term_key"), lay_form(F.concat(F.lit("Při "), "p_type", F.lit("."))).alias("own"))
    d = p.where("p_size < 10").groupBy(F.lower("p_name").alias("term_key")).agg(F.min("p_brand").alias("d"))
    return t.join(d, "term_key", "left").select("p_partkey", "term_key", F.coalesce("d", "own").alias("lay"), F.col("d").isNotNull().alias("from_dictionary"))


# Ages ------------------------------------------------------------------------------------------------------------

_AGE_TEXT = ["'děti ve věku ' || p_size || '–' || (p_size + 5) || ' let'", "'dospělí a dospívající od ' || p_size || ' let'", "'děti mladší ' || p_size || ' měsíců'", "'starší pacienti ' || p_name", "'pacienti s poruchou ledvin'", "'kojenci a batolata'", "p_size || ',5 roku a starší'", "'Novorozenci do ' || p_size || ' týdnů'"]
_AGE_SQL = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_AGE_TEXT)) + " END"


def age_phrases(spark, root):
    """Patient groups in words, made of the sizes and names in ``part``."""
    z = F.col("p_size").cast("string")
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    all_ = [cat("děti ve věku ", z, "–", (F.col("p_size") + 5).cast("string"), " let"), cat("dospělí a dospívající od ", z, " let"), cat("děti mladší ", z, " měsíců"), cat("starší pacienti ", F.col("p_name")), F.lit("pacienti s poruchou ledvin"), F.lit("kojenci a batolata"), cat(z, ",5 roku a starší"), cat("Novorozenci do ", z, " týdnů")]
    out = all_[0]
    for i in range(1, 8):
        out = F.when(F.col("p_partkey") % 8 == i, all_[i]).otherwise(out)
    return table(spark, root, "part").select("p_partkey", "p_size", "p_brand", out.alias("t"))


def _sql_years(n: str, u: str) -> str:
    return f"(replace({n}, ',', '.')::DOUBLE / CASE WHEN {u} LIKE 'mes%' THEN 12 WHEN {u} LIKE 'tyd%' THEN 52 ELSE 1 END)"


def _sql_ages(source: str) -> str:
    """CTEs t (folded text) and a (lo, hi) over ``source`` with columns id, x."""
    g = lambda p, i: f"nullif(regexp_extract(x, '{p}', {i}), '')"
    m = lambda p: f"regexp_matches(x, '{p}')"
    span, before, after, upto = m(U.RANGE), m(U.FROM_BEFORE), m(U.FROM_AFTER), m(U.UP_TO)
    lows = "list_min(list_filter([" + ", ".join(f"CASE WHEN {m(p)} THEN {lo}::DOUBLE END" for p, lo, _ in U.GROUPS) + "], lambda v: v IS NOT NULL))"
    highs = "list_max(list_filter([" + ", ".join(f"CASE WHEN {m(p)} THEN {hi}::DOUBLE END" for p, _, hi in U.GROUPS if hi is not None) + "], lambda v: v IS NOT NULL))"
    open_ = " OR ".join(m(p) for p, _, hi in U.GROUPS if hi is None)
    low = f"CASE WHEN {before} THEN {_sql_years(g(U.FROM_BEFORE, 1), g(U.FROM_BEFORE, 2))} WHEN {after} THEN {_sql_years(g(U.FROM_AFTER, 1), g(U.FROM_AFTER, 2))} END"
    lo = f"CASE WHEN {span} THEN {_sql_years(g(U.RANGE, 1), g(U.RANGE, 3))} WHEN {before} OR {after} OR {upto} THEN coalesce({low}, 0) ELSE {lows} END"
    hi = f"CASE WHEN {span} THEN {_sql_years(g(U.RANGE, 2), g(U.RANGE, 3))} WHEN {before} OR {after} OR {upto} THEN CASE WHEN {upto} THEN {_sql_years(g(U.UP_TO, 1), g(U.UP_TO, 2))} END WHEN NOT ({open_}) THEN {highs} END"
    return f"t AS (SELECT id, {sql_fold('x')} AS x FROM ({source})), a AS (SELECT id, x, {lo} AS lo, {hi} AS hi FROM t)"


@query("age_from_text", f"WITH {_sql_ages(f'SELECT p_partkey AS id, {_AGE_SQL} AS x FROM part')} SELECT id AS p_partkey, round(lo, 4) AS age_from, round(hi, 4) AS age_to FROM a")
def age_from_text(spark, root):
    _, lo, hi = U.age_range(F.col("t"))
    return age_phrases(spark, root).select("p_partkey", F.round(lo, 4).alias("age_from"), F.round(hi, 4).alias("age_to"))


_ASK = ["'lék na reflux pro děti'", "'kašel u ' || ['dvou', 'tří', 'čtyř', 'pěti', 'šesti'][(o_orderkey // 10) % 5 + 1] || 'letého dítěte'", "'horečka dítě ' || (o_orderkey // 10) % 20 || ' let'", "'něco na rýmu pro miminko'", "'bolí mě hlava ' || o_orderpriority", "'dítě tři roky kašel'", "'pro dospělé na bolest'", "'batole má rýmu'", "'bolest ' || (o_orderkey // 10) % 9 || ' roky'", "'pro děti i dospělé půl roku'"]
_ASK_SQL = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_ASK)) + " END"


def questions(spark, root):
    """Lay questions about ages, made of the keys and priorities in ``orders``."""
    k = F.floor(F.col("o_orderkey") / 10).cast("long")
    s = lambda c: c.cast("string")
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    stems = F.array(*[F.lit(x) for x in ("dvou", "tří", "čtyř", "pěti", "šesti")])
    all_ = [F.lit("lék na reflux pro děti"), cat("kašel u ", F.element_at(stems, (k % 5 + 1).cast("int")), "letého dítěte"), cat("horečka dítě ", s(k % 20), " let"), F.lit("něco na rýmu pro miminko"), cat("bolí mě hlava ", F.col("o_orderpriority")), F.lit("dítě tři roky kašel"), F.lit("pro dospělé na bolest"), F.lit("batole má rýmu"), cat("bolest ", s(k % 9), " roky"), F.lit("pro děti i dospělé půl roku")]
    out = all_[0]
    for i in range(1, 10):
        out = F.when(F.col("o_orderkey") % 10 == i, all_[i]).otherwise(out)
    return table(spark, root, "orders").select("o_orderkey", out.alias("q"))


def _sql_map(expr: str, values: dict[str, int]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END::DOUBLE"


def _age_query_sql() -> str:
    m = lambda p: f"regexp_matches(x, '{p}')"
    g = lambda p, i: f"regexp_extract(x, '{p}', {i})"
    scale = lambda n, u: f"({n} / CASE WHEN {u} LIKE 'mes%' THEN 12 WHEN {u} LIKE 'tyd%' THEN 52 ELSE 1 END)"
    digits = f"nullif({g(U.AGE_DIGITS, 1)}, '')::DOUBLE"
    age = f"CASE WHEN {m(U.AGE_DIGITS)} THEN {scale(digits, g(U.AGE_DIGITS, 2))} WHEN {m(U.AGE_STEM)} THEN {scale(_sql_map(g(U.AGE_STEM, 1), U.STEMS), g(U.AGE_STEM, 2))} WHEN {m(U.AGE_CARDINAL)} THEN {scale(_sql_map(g(U.AGE_CARDINAL, 1), U.CARDINALS), g(U.AGE_CARDINAL, 2))} WHEN {m(U.HALF_YEAR)} THEN 0.5 WHEN {m(U.INFANT)} THEN 0.5 WHEN {m(U.TODDLER)} THEN 2 END"
    return f"""WITH t AS (SELECT o_orderkey, {sql_fold(_ASK_SQL)} AS x FROM orders),
a AS (SELECT o_orderkey, x, {age} AS age, {m(U.CHILD)} OR {m(U.INFANT)} OR {m(U.TODDLER)} AS child, {m(U.AGE_STEM)} AS stem, {m(U.ADULTS)} AS ask_adult FROM t),
n AS (SELECT *, age IS NOT NULL AND (age >= 18 OR NOT (child OR stem)) AS none FROM a)
SELECT o_orderkey, CASE WHEN NOT none AND (child OR age IS NOT NULL) THEN true END AS for_children, round(CASE WHEN NOT none THEN age END, 4) AS age,
 ask_adult AND NOT (NOT none AND (child OR age IS NOT NULL)) AS adults FROM n"""


@query("age_from_query", _age_query_sql())
def age_from_query(spark, root):
    children, age = U.age_in_query(F.col("q"))
    return questions(spark, root).select("o_orderkey", children.alias("for_children"), F.round(age, 4).alias("age"), U.adults_in_query(F.col("q")).alias("adults"))


def _strip_sql() -> str:
    x = sql_fold(_ASK_SQL)
    for p in (U.AGE_DIGITS, U.AGE_STEM, U.AGE_CARDINAL, U.HALF_YEAR, U.CHILD, U.INFANT, U.TODDLER, U.ADULTS):
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    x = rf"regexp_replace(trim({x}), '\b(pro|u|pro\s+moje|pro\s+nase|meho|naseho|male[a-z]*)\s*$', ' ', 'g')"
    return rf"SELECT o_orderkey, trim(regexp_replace({x}, '\s+', ' ', 'g')) AS rest FROM orders"


@query("strip_age_words", _strip_sql())
def strip_age_words(spark, root):
    return questions(spark, root).select("o_orderkey", U.without_age(F.col("q")).alias("rest"))


@query("restore_accents", f"""WITH q AS (SELECT o_orderkey, {_ASK_SQL} AS q FROM orders), w AS (SELECT o_orderkey, regexp_split_to_array(q, '\\s+') AS own, regexp_split_to_array({sql_fold('q')} || ' lekar', '\\s+') AS t FROM q)
SELECT o_orderkey, array_to_string(list_transform(t, lambda x: coalesce(list_filter(own, lambda o: {sql_fold('o')} = x)[1], x)), ' ') AS restored FROM w""")
def restore_accents(spark, root):
    """The router's plain words take the user's accents again."""
    plain = F.concat(fold("q"), F.lit(" lekar"))
    return questions(spark, root).select("o_orderkey", U.restore_accents(plain, F.col("q")).alias("restored"))


@query("repair_json_keys")
def repair_json_keys(spark, root):
    """Mistyped keys of answers, made of the event types, mapped to the expected ones."""
    typo = F.concat(F.substring("event_type", 1, 3), F.substring("event_type", 3, 20))
    e = table(spark, root, "events").select("event_id", F.array("event_type", typo, F.lit("zzz")).alias("given"))
    return e.select("event_id", F.array_join(repair_keys(["click", "error", "purchase", "signup", "view"])("given"), ",").alias("names"))


@query("route_questions")
def route_questions(spark, root):
    """The rule router over a table of questions."""
    router = U.RuleRouter({"adverse": ["bolest", "boli"], "indication": ["kasel", "ryma", "horecka"]}, ["adverse", "contraindication", "dosing", "indication"])
    c = router.columns(F.col("q"))
    return questions(spark, root).select("o_orderkey", F.array_join(c["sections"], ",").alias("sections"), *[c[n].alias(n) for n in c if n != "sections"])


@query("definite_age", f"WITH {_sql_ages(f'SELECT p_partkey AS id, {_AGE_SQL} AS x FROM part')}, b AS (SELECT id, x, lo FROM a), " + _sql_ages("SELECT id, regexp_replace(x, '" + U.ANY_CHILD + "', ' ', 'g') AS x FROM b").replace("t AS (", "t2 AS (").replace("a AS (", "a2 AS (", 1).replace("FROM t)", "FROM t2)") + f" SELECT b.id AS p_partkey, round(CASE WHEN regexp_matches(b.x, '{U.RANGE}') OR regexp_matches(b.x, '{U.FROM_BEFORE}') OR regexp_matches(b.x, '{U.FROM_AFTER}') THEN b.lo WHEN regexp_matches(b.x, '{U.UP_TO}') THEN NULL ELSE a2.lo END, 4) AS age_from FROM b JOIN a2 USING (id)")
def definite_age(spark, root):
    return age_phrases(spark, root).select("p_partkey", F.round(U.definite_age_from(F.col("t")), 4).alias("age_from"))


# Vocabularies ----------------------------------------------------------------------------------------------------

_FREQ_IN = ["'Velmi časté (≥1/10)'", "'časté'", "'Méně časté:'", "'VZÁCNÉ'", "'velmi   vzácné'", "'není známo'", "'Ojediněle'", "'frekvence neznámá'", "'jiná ' || value::INT", "''"]
_FREQ_SQL = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_FREQ_IN)) + " END"


def frequency_values(spark, root):
    v = [F.lit("Velmi časté (≥1/10)"), F.lit("časté"), F.lit("Méně časté:"), F.lit("VZÁCNÉ"), F.lit("velmi   vzácné"), F.lit("není známo"), F.lit("Ojediněle"), F.lit("frekvence neznámá"), F.concat(F.lit("jiná "), F.round("value").cast("int").cast("string")), F.lit("")]
    out = v[0]
    for i in range(1, 10):
        out = F.when(F.col("event_id") % 10 == i, v[i]).otherwise(out)
    return table(spark, root, "events").select("event_id", out.alias("v"))


_KEY = f"regexp_replace(trim(regexp_replace({sql_fold('regexp_replace(v, ' + chr(39) + r'\(.*?\)' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '\\s+', ' ', 'g')), ':+$', '')"


def _case(expr: str, table_: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in table_.items()) + " END"


@query("freq_normalize", f"""WITH e AS (SELECT event_id, {_FREQ_SQL.replace("value::INT", "round_even(value, 0)::INT")} AS v FROM events), k AS (SELECT event_id, v, {_KEY} AS k0 FROM e),
s AS (SELECT event_id, v, coalesce({_case('k0', N.SYNONYMS)}, k0) AS k FROM k), r AS (SELECT event_id, v, {_case('k', N.RANKS)} AS r FROM s)
SELECT event_id, CASE WHEN v = '' THEN NULL WHEN r IS NOT NULL THEN {_case('r', N.CANON)} ELSE trim(v) END AS frequency, CASE WHEN v = '' THEN 9 ELSE coalesce(r, 9) END AS freq_rank FROM r""".replace("round_even(value, 0)", "round(value)"))
def freq_normalize(spark, root):
    text, rank = N.frequency(F.col("v"))
    return frequency_values(spark, root).select("event_id", text.alias("frequency"), rank.alias("freq_rank"))


def _misspelt(value, n):
    """A value without its ``n``-th letter; 0 leaves it whole."""
    return F.concat(F.expr(f"substr({value}, 1, {n} - 1)"), F.expr(f"substr({value}, {n} + 1)"))


@query("freq_near")
def freq_near(spark, root):
    """Misspelt frequencies take the nearest wording of the scale."""
    v = frequency_values(spark, root).select("event_id", _misspelt("v", "(event_id % 7 + 1)").alias("v"))
    text, rank = N.near_frequency(F.col("v"))
    return v.select("event_id", "v", text.alias("frequency"), rank.alias("freq_rank"))


_GROUP_CASE = "CASE WHEN trim(coalesce(x, '')) = '' THEN 'neuvedeno' " + " ".join(f"WHEN contains({sql_fold('x')}, '{p}') THEN '{c}'" for p, c in N.GROUP_PARTS) + " ELSE 'jine' END"


@query("group_code", f"SELECT p_partkey, {_GROUP_CASE} AS group_code FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE {_AGE_SQL} END AS x FROM part)")
def group_code(spark, root):
    t = F.when(F.col("p_partkey") % 9 != 0, F.col("t"))
    return age_phrases(spark, root).select("p_partkey", N.group_code(t).alias("group_code"))


@query("organ_normalize", f"""WITH o(pos, name) AS (VALUES {', '.join(f"({i}, '{_text(o)}')" for i, o in enumerate(N.ORGANS))}),
v AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 11 = 1 THEN 'Neznámá ' || p_name ELSE upper(name) || ' (viz bod 4.3)*.' END AS v FROM part JOIN o ON pos = p_partkey % 26),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(v, '(?i)\\s*\\((viz|see)[^)]*\\)|[*†‡]+', '', 'g'), '^[ .:;,]+|[ .:;,]+$', '', 'g') AS c FROM v),
q AS (SELECT p_partkey, c, regexp_replace({sql_fold('c')}, '[^a-z0-9]', '', 'g') AS k FROM c)
SELECT p_partkey, CASE WHEN k = '' THEN NULL ELSE coalesce(name, c) END AS organ, CASE WHEN k = '' THEN 'prazdna' WHEN name IS NOT NULL THEN 'presna' ELSE 'nezname' END AS how
FROM q LEFT JOIN o ON regexp_replace({sql_fold('name')}, '[^a-z0-9]', '', 'g') = k""")
def organ_normalize(spark, root):
    name, how = N.organ(F.col("v"))
    return organ_values(spark, root).select("p_partkey", name.alias("organ"), how.alias("how"))


def organ_values(spark, root):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(o) for o in N.ORGANS])
    v = F.when(k % 11 == 0, " ").when(k % 11 == 1, F.concat(F.lit("Neznámá "), "p_name")).otherwise(F.concat(F.upper(F.element_at(names, (k % 26 + 1).cast("int"))), F.lit(" (viz bod 4.3)*.")))
    return table(spark, root, "part").select("p_partkey", v.alias("v"))


@query("organ_near")
def organ_near(spark, root):
    """Misspelt organ systems take the nearest canonical name."""
    v = organ_values(spark, root).select("p_partkey", _misspelt("v", "(p_partkey % 6)").alias("v"))
    name, how = N.near_organ(F.col("v"))
    return v.select("p_partkey", "v", name.alias("organ"), how.alias("how"))


_RAW = """CASE event_id % 6 WHEN 0 THEN '{"items": [{"text": "' || k || '", "lay": "a"}]}' WHEN 1 THEN '{"items": [{"text": "' || k || '", "lay": "a"}, {"text": ""}]}' WHEN 2 THEN '{"items": []}' WHEN 3 THEN 'not json ' || k
WHEN 4 THEN '{"items": [{"other": "x"}]}' ELSE '```json' || chr(10) || '{"items": [{"text": "' || k || '", "lay": "b"}]}' || chr(10) || '```' END"""


@query("json_answer_state", f"""WITH r AS (SELECT event_id, {_RAW} AS raw FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)),
t AS (SELECT event_id, trim(regexp_replace(trim(raw), '^```[a-zA-Z]*\\s*|\\s*```$', '', 'g')) AS x FROM r), j AS (SELECT event_id, CASE WHEN json_valid(x) THEN json_extract(x, '$.items[*]') END AS items FROM t),
c AS (SELECT event_id, len(items) AS n, len(list_filter(items, lambda i: coalesce(json_extract_string(i, '$.text'), '') <> '' AND coalesce(json_extract_string(i, '$.lay'), '') <> '')) AS ok FROM j)
SELECT event_id, CASE WHEN n IS NULL THEN 'selhala_extrakce' WHEN n = 0 THEN 'prazdna' WHEN ok = 0 THEN 'selhala_extrakce' WHEN ok < n THEN 'castecna' ELSE 'neovereno' END AS state, coalesce(n, 0) AS items, coalesce(ok, 0) AS valid FROM c""")
def json_answer_state(spark, root):
    k = F.get_json_object("props", "$.k")
    c = F.col("event_id") % 6
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    raw = (
        F.when(c == 0, cat('{"items": [{"text": "', k, '", "lay": "a"}]}')).when(c == 1, cat('{"items": [{"text": "', k, '", "lay": "a"}, {"text": ""}]}'))
        .when(c == 2, F.lit('{"items": []}')).when(c == 3, cat("not json ", k)).when(c == 4, F.lit('{"items": [{"other": "x"}]}'))
        .otherwise(cat('```json\n{"items": [{"text": "', k, '", "lay": "b"}]}\n```'))
    )
    state, items, valid = N.answer_state(F.col("raw"), ["text", "lay"])
    return table(spark, root, "events").select("event_id", raw.alias("raw")).select("event_id", state.alias("state"), items.alias("items"), valid.alias("valid"))


_SIG = "list_filter(list_distinct(regexp_extract_all({}, '[a-z]+')), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in N.FILLER) + "], w))"


@query("key_support", f"""WITH t AS (SELECT item_id, doc_id, {_SIG.format(sql_fold("b.text"))} AS k, {_SIG.format(sql_fold("d.text"))} AS s FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)
SELECT item_id, doc_id, len(k) > 0 AND len(list_filter(k, lambda w: CASE WHEN length(w) >= 4 THEN list_contains(list_transform(s, lambda z: substr(z, 1, 4)), substr(w, 1, 4)) ELSE list_contains(s, w) END)) >= 0.5 * len(k) AS supported FROM t""")
def key_support(spark, root):
    """Each document against one item: the words of either side are derived once, before they meet."""
    b = table(spark, root, "benchmark").select("item_id", N.significant(F.col("text")).alias("words"))
    n = b.count()
    d = table(spark, root, "documents", "doc_id", "text").select("doc_id", (F.col("doc_id") % n).alias("item_id"), N.word_starts(F.col("text")).alias("starts"))
    return d.join(b, "item_id").select("item_id", "doc_id", N.supported(F.col("words"), F.col("starts")).alias("supported"))


@query("foreign_script", "SELECT p_partkey, p_partkey % 8 IN (1, 3) AS foreign_ FROM part")
def foreign_script(spark, root):
    """Values with a letter of another script in them: Cyrillic and Chinese are errors, Greek and accents aren't."""
    planted = F.array(*map(F.lit, ["", "\u0435", "\u03b3", "\u4e2d", "\u017e", "a", "1", "\u2265"]))
    value = F.concat(F.substring("p_name", 1, 3), F.get(planted, (F.col("p_partkey") % 8).cast("int")), F.substring("p_name", 4, 100))
    return table(spark, root, "part", "p_partkey", "p_name").select("p_partkey", N.foreign_script(value).alias("foreign_"))


@query("value_in_source", f"""SELECT p_partkey, contains(regexp_replace({sql_fold("'Balení: ' || p_name || ' (' || p_type || ')'")}, '[^a-z0-9]', '', 'g'), regexp_replace({sql_fold("split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 4 = 0 THEN ' navíc' ELSE '' END")}, '[^a-z0-9]', '', 'g')) AS found,
 CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS missing FROM part""")
def value_in_source(spark, root):
    from tessella.functions.text import squash

    k, z = F.col("p_partkey"), F.col("p_size").cast("string")
    source = F.concat(F.lit("Balení: "), "p_name", F.lit(" ("), "p_type", F.lit(")"))
    value = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.when(k % 4 == 0, " navíc").otherwise(""))
    dose = F.concat(z, F.lit(" 000 mg"))  # "7 000" may be read as 7, 000 or 7000; every third size claims a number that isn't there
    claimed = F.when(F.col("p_size") % 3 == 0, F.lit("99999")).otherwise(F.concat(z, F.lit("000")))
    p = table(spark, root, "part")
    return p.select("p_partkey", F.contains(squash(source), squash(value)).alias("found"), F.size(N.missing_numbers(claimed, dose)).alias("missing"))
