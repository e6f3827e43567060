"""Queries over documents, sections, items and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import folder_safe, joined_term, registration_base, simple_upper, squeeze, sql_fold, tokens
from tessella.operators import ages as A
from tessella.operators import conversion as C
from tessella.operators import grids as G
from tessella.operators import quality as Q
from tessella.operators import sections as S
from tessella.operators import trimming as TR
from tessella.plans.registry import query
from tessella.sources.tables import table, written

# Documents -------------------------------------------------------------------------------------------------------


def markdown(spark, root):
    """``pages`` as markdown-like text with numbered sections."""
    p = table(spark, root, "pages", "page_id", "html")
    plain = squeeze(F.regexp_replace("html", "<[^>]*>", " "))
    half = F.floor(F.length(plain) / 2).cast("int")
    head = F.when(F.col("page_id") % 4 == 0, "## 4.l Indications\n").when(F.col("page_id") % 4 == 1, "## 4. CLINICAL4. 1 Indications\n").when(F.col("page_id") % 4 == 2, "# 4 .1. Indications\n").otherwise("Indications\n")
    md = F.concat(F.lit("# Title\n"), head, F.substr(plain, F.lit(1), half), F.lit("\n## 4.2 Dosing\n| a | b |\n|---|---|\n| 1 | 2 |\n"), F.substr(plain, half + 1), F.when(F.col("page_id") % 3 == 0, "\n# PŘÍLOHA II\nrest").otherwise("\n# PŘÍLOHA III\nrest"))
    return p.select("page_id", md.alias("md"))


_MD = r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages),
h AS (SELECT page_id, plain, (length(plain) // 2) AS half, CASE page_id % 4 WHEN 0 THEN '## 4.l Indications' || chr(10) WHEN 1 THEN '## 4. CLINICAL4. 1 Indications' || chr(10) WHEN 2 THEN '# 4 .1. Indications' || chr(10) ELSE 'Indications' || chr(10) END AS head FROM p),
m AS (SELECT page_id, '# Title' || chr(10) || head || substr(plain, 1, half) || chr(10) || '## 4.2 Dosing' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || substr(plain, half + 1) || CASE WHEN page_id % 3 = 0 THEN chr(10) || '# PŘÍLOHA II' || chr(10) || 'rest' ELSE chr(10) || '# PŘÍLOHA III' || chr(10) || 'rest' END AS md, substr(plain, 1, half) AS part FROM h) """


_AT = r"4\s*\.\s*[1lI|!]"  # 4.1 with the digits that recognition confuses


@query("slice_section", _MD + rf""", f AS (SELECT page_id, regexp_extract(md, '(?s)(?:^|\n)#{{1,6}}[ \t]*{_AT}([^0-9\n].*)$', 1) AS plain_, regexp_extract(md, '(?s)(?:^|\n)#{{1,6}}[^\n]*?{_AT}([^0-9\n].*)$', 1) AS merged FROM m),
r AS (SELECT page_id, CASE WHEN plain_ <> '' THEN plain_ ELSE merged END AS rest, CASE WHEN plain_ <> '' THEN '[ \t]*' ELSE '[^\n]*?' END AS gap FROM f),
c AS (SELECT page_id, rest <> '' AS found, CASE WHEN regexp_matches(rest, '\n#{{1,6}}' || gap || '4\s*\.\s*[2Z][^0-9\n]') THEN regexp_replace(rest, '(?s)\n#{{1,6}}' || gap || '4\s*\.\s*[2Z][^0-9\n].*$', '') ELSE left(rest, 40000) END AS part FROM r)
SELECT page_id, found, length(regexp_replace(part, '^\s+|\s+$', '', 'g')) AS chars FROM c""")
def slice_section(spark, root):
    text = S.slice_section(F.col("md"), "4.1", "4.2")
    return markdown(spark, root).select("page_id", text.isNotNull().alias("found"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"))


@query("table_detection", _MD + "SELECT page_id, len(list_filter(string_split(md, chr(10)), lambda x: starts_with(ltrim(x), '|'))) >= 3 AS has_table, len(regexp_extract_all(md, '(?m)^\\|[ \\t:|-]*-[ \\t:|-]*\\|?[ \\t]*$')) AS tables FROM m")
def table_detection(spark, root):
    return markdown(spark, root).select("page_id", S.has_table(F.col("md")).alias("has_table"), S.table_count(F.col("md")).cast("long").alias("tables"))


@query("cut_annex", _MD + r"SELECT page_id, length(regexp_replace(md, '(?ims)^#{1,6}[ \t]*p[rř][ií]loha[ \t]+ii([^i0-9a-z_]|\z).*', '')) AS chars FROM m")
def cut_annex(spark, root):
    return markdown(spark, root).select("page_id", F.length(S.cut_annex(F.col("md"))).cast("long").alias("chars"))


@query("list_to_lines", r"SELECT p_partkey, regexp_replace(p_name || ' ; ' || p_type || ';' || p_brand, '\s*;\s*', chr(10), 'g') AS lines FROM part")
def list_to_lines(spark, root):
    return table(spark, root, "part").select("p_partkey", S.list_to_lines(F.concat("p_name", F.lit(" ; "), "p_type", F.lit(";"), "p_brand")).alias("lines"))


def _broken(word: str) -> str:
    return " ".join([word[:1], word[1:]]) if " " not in word else word.replace(" ", "  ")


_WORDS = ["velmi časté", "Velmi vzácné", "méně časté", "Vzácné", "časté"]
_BROKEN = ["v elmi č asté", "V elmi vz ácné", "mé ně časté", "V zácné", "č asté"]


def _glued_sql(text: str) -> str:
    """Each wording, its letters with or without spaces between them, is written as it should be; the longest first."""
    for word in sorted(S.FREQUENCY_WORDS, key=lambda w: (-len(w), w)):
        letters = [c for c in word if c != " "]
        for first, right in ((letters[0], word), (letters[0].upper(), word[0].upper() + word[1:])):
            text = f"regexp_replace({text}, '{'[ \\t]*'.join([first, *letters[1:]])}', '{right}', 'g')"
    return text


@query("glue_frequency_words", "SELECT event_id, " + _glued_sql("(event_type || ': ' || [" + ", ".join(f"'{w}'" for w in _BROKEN) + "][event_id % 5 + 1] || ' (' || user_id || ')')") + " AS fixed FROM events")
def glue_frequency_words(spark, root):
    words = F.element_at(F.array(*[F.lit(w) for w in _BROKEN]), (F.col("event_id") % 5 + 1).cast("int"))
    t = F.concat("event_type", F.lit(": "), words, F.lit(" ("), F.col("user_id").cast("string"), F.lit(")"))
    return table(spark, root, "events").select("event_id", S.glue_frequency(t).alias("fixed"))


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), m AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 0 THEN '## Dospělí ' || doc_id || ':' WHEN pos % 7 = 4 THEN '# Ostatní' ELSE line END AS line FROM l)"


@query("forward_fill_heading", _LINES + r""", h AS (SELECT *, CASE WHEN pos % 7 = 0 THEN 'Dospělí ' || doc_id WHEN pos % 7 = 4 THEN '' END AS mark FROM m),
f AS (SELECT doc_id, pos, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g, mark IS NOT NULL AS head FROM h)
SELECT doc_id, pos, coalesce(nullif(g, ''), '-') AS patient_group FROM f WHERE NOT head""")
def forward_fill_heading(spark, root):
    lines = S.lines_of(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text")
    k = F.col("pos") % 7
    lines = lines.withColumn("line", F.when(k == 0, F.concat(F.lit("## Dospělí "), F.col("doc_id").cast("string"), F.lit(":"))).when(k == 4, "# Ostatní").otherwise(F.regexp_replace("line", "^#", "")))
    out = S.fill_group_headings(lines, "doc_id").where(~F.col("is_heading"))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.coalesce("group", F.lit("-")).alias("patient_group"))


@query("doc_vocabulary", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2) SELECT doc_id, count(*) FILTER (WHERE length(word) >= 4) AS whole, count(*) FILTER (WHERE length(word) BETWEEN 2 AND 3 AND n >= 3) AS stands FROM c WHERE length(word) >= 4 OR (length(word) >= 2 AND n >= 3) GROUP BY 1")
def doc_vocabulary(spark, root):
    v = S.vocabulary(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text")
    return v.groupBy("doc_id").agg(F.count_if(F.col("kind") == "whole").alias("whole"), F.count_if(F.col("kind") == "stands").alias("stands"))


@query("coverage_ratio", """WITH r AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM benchmark), n AS (SELECT item_id, token, count(*) AS n FROM r GROUP BY 1, 2),
p AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS item_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents), m AS (SELECT item_id, token, count(*) AS m FROM p GROUP BY 1, 2)
SELECT item_id, round(sum(least(n, coalesce(m, 0)))::DOUBLE / sum(n), 10) AS coverage, sum(least(n, coalesce(m, 0)))::DOUBLE / sum(n) < 0.9 AS suspicious FROM n LEFT JOIN m USING (item_id, token) GROUP BY 1""")
def coverage_ratio(spark, root):
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))).alias("token")
    r = table(spark, root, "benchmark").select("item_id", words("text"))
    n = table(spark, root, "benchmark", "item_id").count()
    p = table(spark, root, "documents", "doc_id", "text").select((F.col("doc_id") % n).alias("item_id"), words("text"))
    return S.coverage(r, p, "item_id").select("item_id", F.round("coverage", 10).alias("coverage"), (F.col("coverage") < 0.9).alias("suspicious"))


@query("repair_spacing")
def repair(spark, root):
    """Lengths of texts after broken words are whole again."""
    return C.rejoined(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", F.length("text").alias("chars"))


@query("unique_objects", """WITH o AS (SELECT p_partkey, p_brand, p_size % 5 AS a, p_name[1] AS b, p_size % 3 AS c, p_partkey % 11 = 0 AS bad FROM part)
SELECT p_partkey, CASE WHEN bad THEN NULL ELSE '{"a":' || a || ',"b":{"x":["' || b || '",' || c || '],"y":null}}' END AS canonical, bad AS broken FROM o
QUALIFY bad OR row_number() OVER (PARTITION BY p_brand, a, b, c, bad ORDER BY p_partkey) = 1""")
def unique_objects(spark, root):
    """Objects of each brand, their keys in two orders at two depths, and some that aren't JSON."""
    p = table(spark, root, "part", "p_partkey", "p_brand", "p_name", "p_size")
    a, b, c = (F.col("p_size") % 5).cast("string"), F.substring("p_name", 1, 1), (F.col("p_size") % 3).cast("string")
    x = F.concat(F.lit('"x": ["'), b, F.lit('", '), c, F.lit("]"))
    one = F.concat(F.lit('{"a": '), a, F.lit(', "b": {'), x, F.lit(', "y": null}}'))
    two = F.concat(F.lit('{ "b":{"y":null,'), x, F.lit('},\n"a":'), a, F.lit("}"))
    text = F.when(F.col("p_partkey") % 11 == 0, F.concat(one, F.lit(","))).when(F.col("p_partkey") % 2 == 0, one).otherwise(two)
    return Q.unique_objects(p.withColumn("item", text), ["p_brand"], "item", "p_partkey").select("p_partkey", "canonical", "broken")


def sections_to_trim(spark, root):
    """Texts as lines of a section, the language deciding which, with headings and frequency lines planted by the id."""
    d = table(spark, root, "documents", "doc_id", "text", "lang")
    planted = F.array(*map(F.lit, ["## Dospělí\nDěti od 2 let\n", "Poruchy kůže\n\nČasté: 5 mg\n", "| a |\n|---|\n| 1 |\n", "## Zvláštní populace\n"]))
    lines = F.regexp_replace("text", r"\. ", ".\n")
    half = F.floor(F.length(lines) / 2).cast("int")
    text = F.concat(F.lit("Úvod.\n"), F.get(planted, (F.col("doc_id") % 4).cast("int")), F.substr(lines, F.lit(1), half), F.lit("\nPediatrická populace; 2 tablety\n"), F.substr(lines, half + 1), F.lit("\nHlášení podezření na účinky\nkonec"))
    section = F.when(F.col("lang") == "de", "adverse").when(F.col("lang") == "en", "dosing").when(F.col("lang") == "fr", "indication").otherwise("other")
    return d.select("doc_id", section.alias("section"), text.alias("text"))


@query("section_core")
def section_core(spark, root):
    """The core of every section, as it goes to extraction."""
    core = TR.core(F.col("text"), F.col("section"), trim_dosing=True)
    return sections_to_trim(spark, root).select("doc_id", "section", core.alias("core")).select("doc_id", "section", F.length("core").alias("chars"), F.crc32(F.col("core").cast("binary")).alias("crc"))


# Items -----------------------------------------------------------------------------------------------------------


@query("item_text_join", """WITH i AS (SELECT doc_id, split_part(text, ' ', 1) AS lay, CASE WHEN quality = 1 THEN substr(text, 1, 70) WHEN quality = 0 THEN upper(split_part(text, ' ', 1)) ELSE split_part(text, ' ', 2) END AS technical FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN lower(technical) <> lower(lay) AND length(technical) <= 60 THEN lay || ' (' || technical || ')' ELSE lay END AS item_text FROM i""")
def item_text_join(spark, root):
    d = table(spark, root, "documents", "doc_id", "text").join(table(spark, root, "labels", "doc_id", "quality"), "doc_id", "left")
    word = lambda n: F.split_part(F.substring_index("text", " ", n), F.lit(" "), F.lit(n))  # noqa: E731  splits no more of the text
    lay = F.col("lay")
    technical = F.when(F.col("quality") == 1, F.col("start")).when(F.col("quality") == 0, simple_upper(lay)).otherwise(F.col("second"))
    d = d.select("doc_id", "quality", word(1).alias("lay"), word(2).alias("second"), F.substring("text", 1, 70).alias("start")).select("doc_id", "lay", technical.alias("technical"))
    return d.select("doc_id", joined_term(lay, F.col("technical")).alias("item_text"))


@query("explode_items", _LINES.split(", m AS")[0] + " SELECT doc_id, pos, length(line) AS chars FROM l WHERE NOT list_contains([1, 3], pos) AND trim(line) <> ''")
def explode_items(spark, root):
    """Items to rows with their position; rejected positions and empty texts are left out."""
    items = table(spark, root, "documents", "doc_id", "text").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return items.where(~F.col("pos").isin(1, 3) & (F.trim("line") != "")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("chars"))


@query("identity_row", """WITH x AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), r AS (SELECT l_suppkey, l_partkey, unnest([p_brand, p_type, p_size || ' mg']) AS v, generate_subscripts([1, 2, 3], 1) AS i FROM x JOIN part ON p_partkey = l_partkey),
f AS (SELECT l_suppkey, v, min((l_partkey, i)) AS place FROM r GROUP BY 1, 2)
SELECT l_suppkey, md5(string_agg(v, ' ' ORDER BY place)) AS identity_md5, count(*) AS parts FROM f GROUP BY 1""")
def identity_row(spark, root):
    """One row per document: distinct values over all its codes, in the order they first occur."""
    x = table(spark, root, "lineitem", "l_suppkey", "l_partkey").distinct()
    p = table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), F.array("p_brand", "p_type", F.concat(F.col("p_size").cast("string"), F.lit(" mg"))).alias("vs"))
    rows = x.join(p, "l_partkey").select("l_suppkey", "l_partkey", F.posexplode("vs").alias("i", "v"))
    first = rows.groupBy("l_suppkey", "v").agg(F.min(F.struct("l_partkey", "i")).alias("at"))
    g = first.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("vs"))  # distinct values of one document
    return g.select("l_suppkey", F.md5(F.array_join(F.transform("vs", lambda s: s["v"]), " ")).alias("identity_md5"), F.size("vs").cast("long").alias("parts"))


@query("representative_min", "SELECT DISTINCT l_suppkey, l_partkey, min(l_partkey) OVER (PARTITION BY l_suppkey) AS representative, l_partkey = min(l_partkey) OVER (PARTITION BY l_suppkey) AS is_representative FROM lineitem")
def representative_min(spark, root):
    x = table(spark, root, "lineitem", "l_suppkey", "l_partkey").distinct()
    rep = x.groupBy("l_suppkey").agg(F.min("l_partkey").alias("representative"))
    return x.join(rep, "l_suppkey").withColumn("is_representative", F.col("l_partkey") == F.col("representative"))


@query("dispensing_tristate", "SELECT o_orderkey, CASE WHEN upper(trim(o_orderstatus)) IN ('F') THEN true WHEN upper(trim(o_orderstatus)) IN ('O') THEN false END AS rx, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS reimbursed, CASE WHEN upper(trim(o_orderstatus)) = 'F' THEN 'Rx' WHEN upper(trim(o_orderstatus)) = 'O' THEN 'OTC' ELSE 'unknown' END AS label FROM orders")
def dispensing_tristate(spark, root):
    o = table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    rich = table(spark, root, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("hit")).distinct()
    code = F.upper(F.trim("o_orderstatus"))
    rx = F.when(code == "F", F.lit(True)).when(code == "O", F.lit(False))
    label = F.when(rx, "Rx").when(~rx, "OTC").otherwise("unknown")
    return o.join(rich, "o_custkey", "left").select("o_orderkey", rx.alias("rx"), F.coalesce("hit", F.lit(False)).alias("reimbursed"), label.alias("label"))


@query("registration_base_key", r"SELECT c_custkey, coalesce(nullif(regexp_extract(r, '^(EU/\d+/\d+/\d+)', 1), ''), r) AS base_key, substr(regexp_replace(r || ' ' || c_name, '[^A-Za-z0-9_]', '_', 'g'), 1, 80) AS folder FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'EU/1/' || (c_custkey % 20) || '/' || (c_custkey % 7) || '/00' || (c_custkey % 4) ELSE c_nationkey || '/' || c_custkey || '-C' END AS r FROM customer)")
def registration_base_key(spark, root):
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    r = F.when(k % 3 == 0, F.concat(F.lit("EU/1/"), s(k % 20), F.lit("/"), s(k % 7), F.lit("/00"), s(k % 4))).otherwise(F.concat(s(F.col("c_nationkey")), F.lit("/"), s(k), F.lit("-C")))
    return table(spark, root, "customer").select("c_custkey", registration_base(r).alias("base_key"), folder_safe(F.concat(r, F.lit(" "), "c_name")).alias("folder"))


@query("code_to_name", "SELECT s_suppkey, list_aggregate(list_transform([s_nationkey, (s_nationkey + 7) % 25, 99], lambda k: coalesce((SELECT max(n_name) FROM nation WHERE n_nationkey = k), k::VARCHAR)), 'string_agg', ', ') AS names FROM supplier".replace("list_aggregate(list_transform([s_nationkey, (s_nationkey + 7) % 25, 99], lambda k: coalesce((SELECT max(n_name) FROM nation WHERE n_nationkey = k), k::VARCHAR)), 'string_agg', ', ')", "(SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) || ', ' || (SELECT n_name FROM nation WHERE n_nationkey = (s_nationkey + 7) % 25) || ', 99'"))
def code_to_name(spark, root):
    """Codes in an array to names; a code without a name stays."""
    s = table(spark, root, "supplier").select("s_suppkey", F.posexplode(F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 7) % 25, F.lit(99))).alias("i", "code"))
    n = table(spark, root, "nation").select(F.col("n_nationkey").alias("code"), "n_name")
    named = s.join(n, "code", "left").groupBy("s_suppkey").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("n_name", F.col("code").cast("string")).alias("n")))).alias("x"))
    return named.select("s_suppkey", F.array_join(F.transform("x", lambda v: v["n"]), ", ").alias("names"))


@query("frequency_columns", """WITH l AS (SELECT l_suppkey * 25 + l_orderkey % 25 AS id, l_orderkey AS k, 1 + l_linenumber % 3 AS f, 'word' || chr(97 + (l_partkey % 20)::INT) || 'x' AS w FROM lineitem WHERE l_suppkey % 20 < 15),
v AS (SELECT id, CASE WHEN k % 7 = 0 THEN 1 + f % 3 ELSE f END AS f, w FROM l WHERE k % 11 <> 0),
n AS (SELECT id, f, w, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT id, f, w, count(*) AS m FROM v GROUP BY ALL),
r AS (SELECT id, w, sum(n)::BIGINT AS n, sum(least(n, coalesce(m, 0)))::BIGINT AS ok FROM n LEFT JOIN m USING (id, f, w) GROUP BY 1, 2), t AS (SELECT id, w, sum(m)::BIGINT AS m FROM m GROUP BY 1, 2)
SELECT id, sum(n)::BIGINT AS words, sum(ok)::BIGINT AS correct, sum(least(n, coalesce(m, 0)) - ok)::BIGINT AS elsewhere, sum(n - least(n, coalesce(m, 0)))::BIGINT AS missing FROM r LEFT JOIN t USING (id, w) GROUP BY 1""")
def frequency_columns(spark, root):
    """Tables of some of each supplier's lines by frequency, as HTML with spans and as markdown in which some words moved or went; how far their columns agree."""
    li = table(spark, root, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").where("l_suppkey % 20 < 15")
    f, k = F.col("l_linenumber") % 3, F.col("l_orderkey")
    word = F.concat(F.lit("word"), F.char(F.lit(97) + F.col("l_partkey") % 20), F.lit("x"))
    cell = lambda at, i: F.when(at == i, word).otherwise("")
    moved = F.when(k % 7 == 0, (f + 1) % 3).otherwise(f)
    html = F.concat(F.lit("<tr><td>c</td>"), *[F.concat(F.lit("<td>"), cell(f, i), F.lit("</td>")) for i in range(3)], F.lit("</tr>"))
    line = F.when(k % 11 != 0, F.concat(F.lit("| c | "), cell(moved, 0), F.lit(" | "), cell(moved, 1), F.lit(" | "), cell(moved, 2), F.lit(" |")))
    docs = li.groupBy((F.col("l_suppkey") * 25 + F.col("l_orderkey") % 25).alias("id")).agg(F.array_join(F.collect_list(html), "").alias("h"), F.array_join(F.collect_list(line), "\n").alias("m"))  # one document each
    head = "<table><tr><th rowspan=2>x</th><th colspan=3>y</th></tr><tr><th>Velmi časté</th><th>časté:</th><th>Vzácné</th></tr><tr><td colspan=4>Poruchy oka</td></tr>"
    docs = docs.select("id", G.html_grids(F.concat(F.lit(head), "h", F.lit("</table>"))).alias("h"), G.markdown_grids(F.concat(F.lit("| x | Velmi časté | Časté | vzácné |\n|---|---|---|---|\n"), "m")).alias("m"))
    docs = written(docs, "grids")
    return G.column_agreement(G.column_words(docs, "id", "h"), G.column_words(docs, "id", "m"))


# Ages ------------------------------------------------------------------------------------------------------------

_BANS = """WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 1 THEN 'yes' ELSE 'no' END AS kind, floor(l_quantity / 10) AS lo, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE floor(l_quantity / 10) + l_linenumber END AS hi, CASE WHEN l_suppkey % 4 <> 0 THEN floor(l_quantity / 10) END AS dlo FROM lineitem),
y AS (SELECT l_orderkey, min(CASE WHEN kind = 'yes' THEN dlo END) AS low, list({'lo': lo, 'hi': hi} ORDER BY lo, hi) FILTER (WHERE kind = 'no' AND hi IS NOT NULL) AS bans,
  coalesce(bool_or(kind = 'yes' AND lo < 18), false) AS cy, coalesce(bool_or(kind = 'no' AND lo <= 0 AND (hi IS NULL OR hi >= 18)), false) AS cb FROM b GROUP BY 1),
a AS (SELECT *, CASE WHEN low IS NOT NULL THEN list_reduce(list_concat([low], list_transform(coalesce(bans, []), lambda x: x.lo * 1000 + x.hi)), lambda s, x: CASE WHEN floor(x / 1000) <= s AND s < x - floor(x / 1000) * 1000 THEN x - floor(x / 1000) * 1000 ELSE s END) END AS age FROM y)
SELECT l_orderkey, round(age, 2) AS age_from, CASE WHEN age IS NULL THEN CASE WHEN cb THEN false WHEN cy THEN true END ELSE age < 18 OR (cy AND NOT cb) END AS for_children FROM a"""


@query("age_reasons", """WITH e AS (SELECT l_orderkey, l_linenumber, '4.' || (1 + l_linenumber % 3) AS part, CASE WHEN l_linenumber % 3 = 1 THEN 'yes' WHEN l_linenumber % 3 = 2 THEN 'no' END AS kind, floor(l_quantity / 10)::INT AS lo, l_linenumber % 5 = 0 AS open_, l_partkey FROM lineitem),
t AS (SELECT l_orderkey, part, l_linenumber, l_partkey, CASE WHEN l_partkey % 9 = 0 THEN part || ' other form, not counted: group ' || l_partkey WHEN kind = 'no' THEN part || ' no ' || lo || CASE WHEN open_ THEN ' and over' ELSE '-' || (lo + 2) || '.5' END || ': group ' || l_partkey
  WHEN kind = 'yes' AND lo > 1 THEN part || ' yes from ' || lo || ': group ' || l_partkey WHEN kind = 'yes' THEN part || ' yes, no age: group ' || l_partkey END AS line FROM e)
SELECT l_orderkey, coalesce(string_agg(line, '|' ORDER BY part, l_linenumber, line), 'no age in the text') AS reasons FROM t GROUP BY 1""")
def age_reasons(spark, root):
    """The audit list of each document's age: lines stand for pieces of evidence."""
    n, lo = F.col("l_linenumber"), F.floor(F.col("l_quantity") / 10)
    e = table(spark, root, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey").select(
        "l_orderkey", n.alias("position"), F.concat(F.lit("4."), (1 + n % 3).cast("string")).alias("part"), F.when(n % 3 == 1, "yes").when(n % 3 == 2, "no").alias("kind"), lo.cast("double").alias("lo"),
        F.when(n % 5 != 0, lo + 2.5).alias("hi"), F.when(lo > 1, lo.cast("double")).alias("definite_lo"), F.concat(F.lit("group "), F.col("l_partkey").cast("string")).alias("patient"), (F.col("l_partkey") % 9 == 0).alias("other_form"),
    )
    return A.age_reasons(e, "l_orderkey").select("l_orderkey", F.array_join("reasons", "|").alias("reasons"))


@query("min_age_fixpoint", _BANS)
def min_age_fixpoint(spark, root):
    n = F.col("l_linenumber")
    tens = F.floor(F.col("l_quantity") / 10).cast("double")
    e = table(spark, root, "lineitem").select("l_orderkey", F.when(n % 3 == 1, "yes").otherwise("no").alias("kind"), tens.alias("lo"), F.when(n % 5 != 0, tens + n).alias("hi"), F.when(F.col("l_suppkey") % 4 != 0, tens).alias("definite_lo"))
    return A.minimum_age(e, "l_orderkey")


_DOSES = ["'2 tablety denně'", "'Nedoporučuje se'", "'neuvedeno'", "'jedna injekce'", "'podle potřeby'"]
_NOTES = ["'pouze na doporučení lékaře'", "''", "'nebyla stanovena'"]


@query("dose_kind", f"""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 {' '.join(f'WHEN {i} THEN {d}' for i, d in enumerate(_DOSES))} END AS dose, CASE p_size % 3 {' '.join(f'WHEN {i} THEN {d}' for i, d in enumerate(_NOTES))} END AS note, CASE WHEN p_size % 2 = 0 THEN 'TBL NOB' ELSE 'INJ SOL' END AS form FROM part),
f AS (SELECT p_partkey, form, {sql_fold('dose')} AS d, {sql_fold('note')} AS n FROM p)
SELECT p_partkey, CASE WHEN regexp_matches(d, '{A.BAN}') THEN 'no' WHEN regexp_matches(n, '{A.DOCTOR_ONLY}') THEN 'no' WHEN regexp_matches(d, '{A.DOSE}') THEN 'yes' WHEN regexp_matches(n, '{A.BAN}') THEN 'no' END AS kind,
 (contains(d, 'tablet') AND form = 'INJ SOL') OR (contains(d, 'injek') AND form = 'TBL NOB') AS other_form FROM f""")
def dose_kind(spark, root):
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v.strip("'")) for v in values]), (c % len(values) + 1).cast("int"))
    p = table(spark, root, "part").select("p_partkey", pick(_DOSES, F.col("p_partkey")).alias("dose"), pick(_NOTES, F.col("p_size")).alias("note"), F.when(F.col("p_size") % 2 == 0, "TBL NOB").otherwise("INJ SOL").alias("form"))
    return p.select("p_partkey", A.dose_kind(F.col("dose"), F.col("note")).alias("kind"), A.other_form(F.col("dose"), F.col("form")).alias("other_form"))


@query("tags_conditions", f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(x, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{k}{chr(39)} END' for k, p in A.CONDITIONS.items())}], lambda v: v IS NOT NULL), ',') AS tags FROM (SELECT doc_id, {sql_fold('text || CASE WHEN doc_id % 3 = 0 THEN ' + chr(39) + ' ledvin 5 kg' + chr(39) + ' ELSE ' + chr(39) + ' těhotné' + chr(39) + ' END')} AS x FROM documents)")
def tags_conditions(spark, root):
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " ledvin 5 kg").otherwise(" těhotné"))
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", F.array_join(A.conditions(t), ",").alias("tags"))


# Quality ---------------------------------------------------------------------------------------------------------


@query("section_coverage", "WITH g AS (SELECT source, list_sort(list(DISTINCT lang) FILTER (WHERE n_chars > 20000)) AS p FROM documents GROUP BY 1) SELECT source, array_to_string(coalesce(p, []), ',') AS present, array_to_string(list_filter(['de', 'en', 'es', 'fr'], lambda x: NOT list_contains(coalesce(p, []), x)), ',') AS missing FROM g WHERE len(list_filter(['de', 'en', 'es', 'fr'], lambda x: NOT list_contains(coalesce(p, []), x))) > 0")
def section_coverage(spark, root):
    d = table(spark, root, "documents", "source", "lang", "n_chars")
    out = Q.section_coverage(d.select("source").distinct(), d.where("n_chars > 20000").select("source", "lang").distinct(), "source", "lang", ["en", "de", "fr", "es"])
    return out.select("source", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


@query("having_suspicious", "SELECT source, lang, count(*) AS items, max(length(text)) AS longest FROM documents GROUP BY 1, 2 HAVING count(*) > 30 OR max(length(text)) > 25000")
def having_suspicious(spark, root):
    out = Q.suspicious(table(spark, root, "documents", "source", "lang", "text"), ["source", "lang"], "text", 30, 25000)
    return out.withColumn("longest", F.col("longest").cast("long"))


@query("dedup_rows", "SELECT count(*) AS total, count(DISTINCT (text, lang)) AS distinct_rows, count(*) - count(DISTINCT (text, lang)) AS duplicates FROM documents")
def dedup_rows(spark, root):
    return Q.duplicates(table(spark, root, "documents", "text", "lang"), ["text", "lang"])


_KEYS = "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 50 AS t, 'k' || (l_quantity::INT % 7) || CASE WHEN l_tax > 0.04 THEN 'x' ELSE '' END AS k FROM lineitem), c AS (SELECT t, k, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT t, k FROM c QUALIFY row_number() OVER (PARTITION BY t ORDER BY n DESC, length(k), k) = 1) "


@query("key_unify", _KEYS + "SELECT t, k FROM b")
def key_unify(spark, root):
    return Q.unify_key(_keyed(spark, root), "t", "k")


@query("null_safe_update", _KEYS + "SELECT id, r.k AS old, b.k AS new FROM r JOIN b USING (t) WHERE b.k IS DISTINCT FROM r.k")
def null_safe_update(spark, root):
    return Q.changed_keys(_keyed(spark, root), "id", "t", "k")


def _keyed(spark, root):
    k = F.concat(F.lit("k"), (F.col("l_quantity").cast("int") % 7).cast("string"), F.when(F.col("l_tax") > 0.04, "x").otherwise(""))
    return table(spark, root, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 50).alias("t"), k.alias("k"))


@query("atc_mismatch", """WITH r AS (SELECT DISTINCT l_partkey % 40 AS term, CASE WHEN l_suppkey % 11 = 0 THEN 'Z' ELSE substr(p_type, 1, 1 + (l_partkey % 40 % 2)) END AS cls, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey),
p AS (SELECT term, cls, count(*) AS holders FROM r GROUP BY 1, 2), s AS (SELECT term, count(DISTINCT l_suppkey) AS h FROM r GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 8),
w AS (SELECT *, sum(holders) OVER (PARTITION BY term) AS total, max(holders) OVER (PARTITION BY term) AS most FROM p WHERE term IN (SELECT term FROM s))
SELECT term, cls, holders, round(holders::DOUBLE / total, 10) AS share FROM w WHERE most::DOUBLE / total >= 0.2 AND holders::DOUBLE / total < 0.1""")
def atc_mismatch(spark, root):
    li = table(spark, root, "lineitem", "l_partkey", "l_suppkey").join(table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    cls = F.when(F.col("l_suppkey") % 11 == 0, "Z").otherwise(F.substr("p_type", F.lit(1), (F.lit(1) + F.col("l_partkey") % 40 % 2).cast("int")))
    out = Q.rare_class(li.select((F.col("l_partkey") % 40).alias("term"), cls.alias("cls"), "l_suppkey"), "term", "cls", "l_suppkey", 8, 0.1, 0.2)
    return out.withColumn("share", F.round("share", 10))


@query("fragment_detectors", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
i AS (SELECT doc_id, pos, trim(line) AS t, len(regexp_split_to_array(trim(line), '\s+')) AS n FROM l WHERE trim(line) <> ''),
w AS (SELECT *, lower(regexp_replace(split_part(t, ' ', 1), '^[(,]+|[(,]+$', '', 'g')) AS f, (SELECT max(j.n) FROM i j WHERE j.doc_id = i.doc_id AND j.pos <> i.pos) AS o FROM i),
r AS (SELECT doc_id, pos, CASE WHEN regexp_matches(f, '^(u|s|se|při|pro|po|ke|k|v|ve|z|ze|of|in|with|de|en|von|mit)$') THEN 'preposition' WHEN regexp_matches(f, '^[\p{L}-]+(em|ou|ami|ech|ím|ými|ích|ého|ému|ým)$') AND substr(t, 1, 1) <> upper(substr(t, 1, 1)) THEN 'inflected' WHEN n <= 2 AND o >= 8 THEN 'short' END AS reason FROM w)
SELECT doc_id, pos, reason FROM r WHERE reason IS NOT NULL""")
def fragment_detectors(spark, root):
    lines = S.lines_of(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text").withColumn("t", F.trim("line")).where("t != ''")
    lines = lines.withColumn("n", F.size(F.split("t", r"\s+"))).withColumn("other", Q.longest_other("n", ["doc_id"], "pos"))
    return lines.withColumn("reason", Q.fragment_reason(F.col("t"), F.col("other"))).where("reason IS NOT NULL").select("doc_id", F.col("pos").cast("long").alias("pos"), "reason")


@query("column_agreement", """WITH a AS (SELECT event_type AS col, unnest(regexp_extract_all(props, '[0-9a-z]+')) AS token, event_id FROM events), x AS (SELECT col, token, count(*) AS n FROM a WHERE event_id % 2 = 0 GROUP BY 1, 2), y AS (SELECT col, token, count(*) AS m FROM a WHERE event_id % 3 <> 0 GROUP BY 1, 2)
SELECT col, sum(least(n, coalesce(m, 0)))::BIGINT AS same, sum(n)::BIGINT AS total, count(*) FILTER (WHERE m IS NULL) AS lost FROM x LEFT JOIN y USING (col, token) GROUP BY 1""")
def column_agreement(spark, root):
    """Tokens of each column in a produced table against the source, as multisets."""
    a = table(spark, root, "events", "event_id", "event_type", "props").select("event_id", F.col("event_type").alias("col"), F.explode(F.regexp_extract_all("props", F.lit("[0-9a-z]+"), F.lit(0))).alias("token"))
    x = a.where("event_id % 2 = 0").groupBy("col", "token").agg(F.count("*").alias("n"))
    y = a.where("event_id % 3 != 0").groupBy("col", "token").agg(F.count("*").alias("m"))
    j = x.join(y, ["col", "token"], "left")
    return j.groupBy("col").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("same"), F.sum("n").alias("total"), F.count_if(F.col("m").isNull()).alias("lost"))


@query("suggestion_list", f"WITH w AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all({sql_fold('text')}, '[a-z0-9]+')) AS word FROM documents) SELECT word, count(DISTINCT source) AS sources, count(*) AS docs FROM w WHERE starts_with(word, 'er') GROUP BY 1 ORDER BY count(*) DESC, length(word), word LIMIT 10")
def suggestion_list(spark, root):
    w = table(spark, root, "documents", "doc_id", "source", "text").select("doc_id", "source", F.explode(F.array_distinct(tokens("text"))).alias("word")).where(F.col("word").startswith("er"))
    g = w.groupBy("word").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("docs"))
    return g.orderBy(F.desc("docs"), F.length("word"), "word").limit(10)


@query("variant_item_counts", "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, array_to_string(list_sort(list(DISTINCT role)), ',') AS all_roles, sum(len(string_split(text, ' ')))::BIGINT AS words FROM conversations GROUP BY 1")
def variant_item_counts(spark, root):
    c = table(spark, root, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("all_roles"), F.sum(F.size(F.split("text", " "))).alias("words"))
