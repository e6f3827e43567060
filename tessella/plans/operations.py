"""Queries over queues, upserts, logs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import cost, dosing_row, item_text, plural, sql_fold
from tessella.operators import encoding as E
from tessella.operators import queues as Q
from tessella.operators.filling import filled, with_running
from tessella.operators.selection import at_ranks
from tessella.plans.registry import query
from tessella.sources.tables import reload, table, work_path
from tessella.streaming import runlog

# Queues ----------------------------------------------------------------------------------------------------------


@query("queue_priority", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderkey LIMIT 100")
def queue_priority(spark, root):
    o = table(spark, root, "orders").where("o_orderstatus = 'O'")
    return o.orderBy("o_orderpriority", "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("usage_priority", "SELECT l_partkey, count(DISTINCT l_suppkey) AS used_by, count(*) AS lines FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 200")
def usage_priority(spark, root):
    g = table(spark, root, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("used_by"), F.count("*").alias("lines"))
    return g.orderBy(F.desc("used_by"), F.desc("lines"), "l_partkey").limit(200)


@query("interleave_1_10", """WITH q AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS first, row_number() OVER (PARTITION BY o_orderpriority = '1-URGENT' ORDER BY o_orderkey) AS i FROM orders),
p AS (SELECT *, CASE WHEN first THEN (i - 1) * 11 + 1 ELSE ((i - 1) // 10) * 11 + 2 + (i - 1) % 10 END AS place FROM q), n AS (SELECT *, row_number() OVER (ORDER BY place) AS position FROM p)
SELECT o_orderkey, position, (position - 1) // 200 + 1 AS batch FROM n""")
def interleave_1_10(spark, root):
    o = table(spark, root, "orders", "o_orderkey", "o_orderpriority").withColumn("first", F.col("o_orderpriority") == "1-URGENT")
    urgent = Q.numbered(o.where("first"), "o_orderkey", [], "i", 16)
    rest = Q.numbered(o.where("NOT first"), "o_orderkey", [], "i", 16)
    placed = urgent.unionByName(rest).withColumn("place", Q.interleaved(F.col("first"), F.col("i")))
    out = Q.numbered(placed, "place", [], "position", 16)
    return out.select("o_orderkey", "position", Q.batch_number(F.col("position"), 200).alias("batch"))


_REQUESTS = """SELECT *, (l_quantity * 100 * 0.15 + l_quantity * 30 * 0.6) / 1000000 * 0.5 AS usd, l_linenumber = 7 AS bad FROM lineitem"""


@query("pack_batches", f"""WITH RECURSIVE r AS ({_REQUESTS}), q AS MATERIALIZED (SELECT *, row_number() OVER w AS i, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM r WHERE NOT bad WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
b(batch, first_, sofar) AS (SELECT 1, 1::BIGINT, 0::DOUBLE UNION ALL
  SELECT batch + 1, n.i, n.upto - n.l_quantity FROM b, LATERAL (SELECT i, upto, l_quantity FROM q WHERE i > first_ AND (upto > sofar + 5000 OR i >= first_ + 150) ORDER BY i LIMIT 1) n),
s AS (SELECT q.*, batch FROM q ASOF JOIN b ON q.i >= b.first_), c AS (SELECT batch, sum(sum(usd)) OVER (ORDER BY batch) AS spent FROM s GROUP BY batch)
SELECT l_orderkey, l_linenumber, l_quantity, batch::BIGINT AS batch, CASE WHEN spent <= (SELECT 0.6 * sum(usd) FROM r) THEN 'sent' ELSE 'waiting' END AS state, round(usd, 12) AS est_usd FROM s JOIN c USING (batch)
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, NULL, 'fault', round(usd, 12) FROM r WHERE bad""")
def pack_batches(spark, root):
    """Requests (lines) filled into batches of 5,000 tokens and 150 rows at most, as far as three fifths of the money go; every seventh line can't be sent."""
    li = table(spark, root, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    li = li.withColumn("usd", cost(F.col("l_quantity") * 100, F.col("l_quantity") * 30, 0.15, 0.6, 0.5))
    total = li.agg(F.sum("usd")).first()[0]
    out = filled(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_extendedprice"], "l_quantity", 5000, 150, fault=F.col("l_linenumber") == 7, cost="usd", ceiling=0.6 * total)
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "batch", "state", F.round("usd", 12).alias("est_usd"))


# Upserts ---------------------------------------------------------------------------------------------------------


@query("upsert_latest", """WITH b AS (SELECT o_custkey, o_orderpriority, o_orderkey AS version, o_totalprice, 0 AS n FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_custkey, o_orderpriority, version, o_totalprice FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY version DESC, n DESC) = 1""")
def upsert_latest(spark, root):
    o = table(spark, root, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("version"), "o_totalprice")
    return Q.upsert(o.where("version % 3 != 0"), o.where("version % 3 = 0"), ["o_custkey", "o_orderpriority"], "version")


@query("insert_ignore", """WITH o AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS k, c_custkey AS id FROM customer), n AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_nationkey END AS k, 100000 + s_suppkey AS id FROM supplier)
SELECT coalesce(k, -1) AS k, id FROM o UNION ALL SELECT coalesce(k, -1), id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k IS NOT DISTINCT FROM n.k)""")
def insert_ignore(spark, root):
    c = table(spark, root, "customer").select(F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("k"), F.col("c_custkey").alias("id"))
    s = table(spark, root, "supplier").select(F.when(F.col("s_suppkey") % 9 != 0, F.col("s_nationkey")).alias("k"), (F.col("s_suppkey") + 100000).alias("id"))
    return Q.insert_ignore(c, s, ["k"]).withColumn("k", F.coalesce("k", F.lit(-1)))


@query("reload_guard", """SELECT 'orders' AS name, count(*) AS before, count(*) AS after, (SELECT count(DISTINCT s_suppkey % 10) FROM supplier) AS reloaded FROM orders
UNION ALL SELECT 'customer', count(*), count(*), (SELECT count(DISTINCT s_suppkey % 10) FROM supplier) FROM customer""")
def reload_guard(spark, root):
    """A table of suppliers by kind is loaded anew, twice over the same path, while the counts of protected tables are watched."""
    path = work_path(spark, "reloaded")
    s = table(spark, root, "supplier", "s_suppkey").groupBy((F.col("s_suppkey") % 10).alias("kind")).agg(F.count("*").alias("n"))
    protected = {n: f"{root}/{n}.parquet" for n in ("orders", "customer")}
    reload(s, path, protected)
    counts = reload(s, path, protected)
    rows = spark.createDataFrame([(n, *c) for n, c in counts.items()], "name string, before long, after long")
    return rows.crossJoin(F.broadcast(spark.read.parquet(path).agg(F.count("*").alias("reloaded"))))  # one row


@query("reconcile_orphans", "WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT coalesce(c_custkey, k) AS batch, CASE WHEN k IS NULL THEN 'orphan' WHEN c_custkey IS NULL THEN 'lost' ELSE 'paired' END AS state FROM (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) FULL JOIN l ON c_custkey = k")
def reconcile_orphans(spark, root):
    remote = table(spark, root, "customer", "c_custkey").where("c_custkey % 7 != 0")
    local = table(spark, root, "orders").select(F.col("o_custkey").alias("k")).distinct()
    j = remote.join(local, F.col("c_custkey") == F.col("k"), "full")
    return j.select(F.coalesce("c_custkey", "k").alias("batch"), F.when(F.col("k").isNull(), "orphan").when(F.col("c_custkey").isNull(), "lost").otherwise("paired").alias("state"))


@query("inventory_diff", "SELECT p_partkey AS code, 'vanished' AS change FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT DISTINCT l_partkey, 'kept' FROM lineitem")
def inventory_diff(spark, root):
    p = table(spark, root, "part").select(F.col("p_partkey").alias("code"))
    now = table(spark, root, "lineitem").select(F.col("l_partkey").alias("code")).distinct()
    return p.join(now, "code", "left_anti").withColumn("change", F.lit("vanished")).unionByName(now.withColumn("change", F.lit("kept")))


@query("identity_propagation", "SELECT c_custkey, c_nationkey * 10 + c_custkey % 4 AS base, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_custkey END, min(CASE WHEN c_custkey % 5 = 0 THEN c_custkey END) OVER (PARTITION BY c_nationkey * 10 + c_custkey % 4), -1) AS document FROM customer")
def identity_propagation(spark, root):
    """Codes without a document take it from their registration group."""
    c = table(spark, root, "customer").select("c_custkey", (F.col("c_nationkey") * 10 + F.col("c_custkey") % 4).alias("base"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey")).alias("own"))
    first = c.groupBy("base").agg(F.min("own").alias("first"))
    return c.join(first, "base").select("c_custkey", "base", F.coalesce("own", "first", F.lit(-1)).alias("document"))


# Logs and reports ------------------------------------------------------------------------------------------------


@query("state_histogram", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS users_high, sum(value) / count(*) AS mean FROM events GROUP BY 1 HAVING count(*) > 10".replace("sum(value) / count(*) AS mean", "round(avg(value), 6) AS mean"))
def state_histogram(spark, root):
    high = F.col("value") > 50
    g = table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(high).alias("high"), F.countDistinct(F.when(high, F.col("user_id"))).alias("users_high"), F.round(F.avg("value"), 6).alias("mean"))
    return g.where("n > 10")


@query("latency_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(median(value), 8) AS median, max(value) FILTER (WHERE i = greatest(floor(n * 0.9)::BIGINT, 1)) AS p90, max(value) AS worst FROM r GROUP BY 1""")
def latency_percentiles(spark, root):
    """Median, the p90 by index (the floor(0.9 n)-th value) and the maximum."""
    e = table(spark, root, "events", "event_id", "event_type", "value")
    n = e.groupBy("event_type").agg(F.count("value").alias("n"), F.max("value").alias("worst"))
    ranks = F.array(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2), F.greatest(F.floor(F.col("n") * 0.9), F.lit(1)).cast("long"))
    wanted = n.select("event_type", F.posexplode(ranks).alias("which", "rank"))
    got = at_ranks(e.where("value IS NOT NULL"), "event_type", "value", ["event_id"], wanted).groupBy("event_type").agg(
        F.round(F.avg(F.when(F.col("which") < 2, F.col("value"))), 8).alias("median"), F.max(F.when(F.col("which") == 2, F.col("value"))).alias("p90")
    )
    return got.join(n, "event_type").select("event_type", "median", "p90", "worst")


@query("percentile_samples", """WITH r AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, p::DOUBLE AS p, doc_id, n_chars FROM r JOIN (VALUES (0.1), (0.5), (0.95)) v(p) ON i = least(floor(n * p::DOUBLE)::BIGINT + 1, n)""")
def percentile_samples(spark, root):
    d = table(spark, root, "documents", "lang", "doc_id", "n_chars")
    n = d.groupBy("lang").agg(F.count("*").alias("n")).where("lang IS NOT NULL").withColumn("p", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.95))))
    wanted = n.select("lang", "p", F.least(F.floor(F.col("n") * F.col("p")) + 1, F.col("n")).alias("rank"))
    return at_ranks(d, "lang", "n_chars", ["doc_id"], wanted).select("lang", "p", "doc_id", "n_chars")


@query("ema", "SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY ts, event_id), lambda s, x: 0.8 * s + 0.2 * x), 8) AS ema FROM events GROUP BY 1")
def ema(spark, root):
    """Exponential moving average 0.8 / 0.2 in time order, per user."""
    g = table(spark, root, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("xs"))
    fold_ = F.aggregate(F.slice("xs", F.lit(2), F.size("xs")), F.element_at("xs", 1)["value"], lambda s, x: s * 0.8 + x["value"] * 0.2)
    return g.select("user_id", "n", F.round(fold_, 8).alias("ema"))


@query("severity_report", """WITH s AS (SELECT doc_id, source, CASE WHEN toxic = 1 AND quality = 0 THEN 1 WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 3 WHEN quality = 1 THEN 5 ELSE 4 END AS severity, n_chars FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, severity, count(*) AS docs, sum(n_chars)::BIGINT AS chars, row_number() OVER (PARTITION BY severity ORDER BY count(*) DESC, source) AS place FROM s GROUP BY 1, 2""")
def severity_report(spark, root):
    d = table(spark, root, "documents", "doc_id", "source", "n_chars").join(table(spark, root, "labels"), "doc_id", "left")
    toxic, bad = F.col("toxic") == 1, F.col("quality") == 0
    severity = F.when(toxic & bad, 1).when(toxic, 2).when(bad, 3).when(F.col("quality") == 1, 5).otherwise(4)
    g = d.groupBy("source", severity.alias("severity")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("severity").orderBy(F.desc("docs"), "source")).cast("long"))


_EVENT_RANK = "CASE coalesce(event_type, '-') WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 9 END"


@query("section_summary", f"""WITH e AS (SELECT user_id, CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_type END AS event_type, event_id FROM events),
g AS (SELECT user_id, coalesce(event_type, 'unknown') AS frequency, {_EVENT_RANK.replace("'-'", "'unknown'")} AS freq_rank, count(*) AS n FROM e GROUP BY 1, 2, 3)
SELECT user_id, frequency, freq_rank, n, n || CASE WHEN n = 1 THEN ' case' WHEN n BETWEEN 2 AND 4 THEN ' cases (few)' ELSE ' cases' END AS label, row_number() OVER (PARTITION BY user_id ORDER BY freq_rank, frequency) AS place FROM g""")
def section_summary(spark, root):
    kind = F.coalesce(F.when(F.col("event_id") % 8 != 0, F.col("event_type")), F.lit("unknown"))
    ranks = {"purchase": 1, "signup": 2, "click": 3, "view": 4}
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("frequency")), F.lit(9))
    g = table(spark, root, "events").groupBy("user_id", kind.alias("frequency")).agg(F.count("*").alias("n")).withColumn("freq_rank", rank)
    label = F.concat(F.col("n").cast("string"), F.lit(" "), plural(F.col("n"), "case", "cases (few)", "cases"))
    return g.select("user_id", "frequency", "freq_rank", "n", label.alias("label"), F.row_number().over(Window.partitionBy("user_id").orderBy("freq_rank", "frequency")).cast("long").alias("place"))


@query("first_distinct_values", "WITH f AS (SELECT source, lang, min(doc_id) AS at FROM documents GROUP BY 1, 2) SELECT source, array_to_string(list(lang ORDER BY at)[1:2], ',') AS langs, count(*) AS n FROM f GROUP BY 1".replace("AS at", "AS place").replace("BY at", "BY place"))
def first_distinct_values(spark, root):
    """The first two distinct values of each group in document order."""
    f = table(spark, root, "documents", "source", "lang", "doc_id").groupBy("source", "lang").agg(F.min("doc_id").alias("place"))
    g = f.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "lang"))).alias("x"))
    return g.select("source", F.array_join(F.transform(F.slice("x", 1, 2), lambda v: v["lang"]), ",").alias("langs"), F.size("x").cast("long").alias("n"))


@query("other_items", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT source, text, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5) s WHERE s.source = d.source AND s.text = d.text)")
def other_items(spark, root):
    """Items of each section that aren't already shown (the five longest are)."""
    d = table(spark, root, "documents", "doc_id", "source", "text", "n_chars")
    shown = d.select("source", "doc_id", "n_chars", F.xxhash64("text").alias("h"), "text").withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("r <= 5")
    return d.join(shown.select("source", "text"), ["source", "text"], "left_anti").select("doc_id", "source")


@query("selected_frequencies", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase') AND value > 90")
def selected_frequencies(spark, root):
    """Rows of the chosen values; choosing none means all."""
    chosen = ["click", "purchase"]
    e = table(spark, root, "events", "event_id", "event_type", "value")
    return e.where((F.col("event_type").isin(*chosen) if chosen else F.lit(True)) & (F.col("value") > 90))


@query("pivot_items", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'view') AS view_ FROM events GROUP BY 1")
def pivot_items(spark, root):
    p = table(spark, root, "events", "user_id", "event_type").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "view"]).count()
    return p.na.fill(0).withColumnRenamed("view", "view_")


_ITEM = """SELECT event_id, ['dosing', 'adverse', 'indication', 'other'][event_id % 4 + 1] AS section, event_type AS a, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE user_id || ' mg' END AS b, CASE WHEN event_id % 3 <> 0 THEN upper(event_type) END AS c FROM events"""


def extracted_items(spark, root):
    """Events as extracted items: JSON with the fields of all sections, some of them blank or missing."""
    k = F.col("event_id")
    section = F.get(F.array(*map(F.lit, ["dosing", "adverse", "indication", "other"])), (k % 4).cast("int"))
    b = F.when(k % 5 == 0, " ").otherwise(F.concat(F.col("user_id").cast("string"), F.lit(" mg")))
    c = F.when(k % 3 != 0, F.upper("event_type"))
    fields = F.struct(F.col("event_type").alias("patient"), b.alias("dose"), c.alias("frequency"), F.col("event_type").alias("lay"), b.alias("effect"), c.alias("verbatim"))
    return table(spark, root, "events", "event_id", "event_type", "user_id").select("event_id", section.alias("section"), F.to_json(fields).alias("item"))


@query("item_texts", f"""WITH i AS ({_ITEM}), n AS (SELECT *, nullif(trim(b), '') AS d FROM i), j(event_id, lay, technical, section, item_text) AS (SELECT event_id, a, CASE section WHEN 'adverse' THEN d ELSE c END, section, concat_ws(' ', a, d, c) FROM n)
SELECT event_id, CASE WHEN section = 'dosing' THEN item_text WHEN section = 'other' THEN 'json' WHEN lower(technical) <> lower(lay) THEN lay || ' (' || technical || ')' ELSE lay END AS item_text FROM j""")
def item_texts(spark, root):
    """Searchable texts of items of all sections; those of other sections are their JSON."""
    text = item_text(F.col("section"), F.col("item"))
    return extracted_items(spark, root).select("event_id", F.when(text.startswith("{"), "json").otherwise(text).alias("item_text"))


@query("dosing_table", f"WITH i AS ({_ITEM}) SELECT event_id, a AS patient, b AS dose, coalesce(c, '') AS frequency, '' AS note FROM i WHERE section = 'dosing'")
def dosing_table(spark, root):
    """Dosing items as a table of four columns."""
    return extracted_items(spark, root).where("section = 'dosing'").select("event_id", dosing_row(F.col("item")).alias("r")).select("event_id", "r.*")


@query("dictionary_listing", "SELECT lower(p_type) AS expr, count(DISTINCT p_brand) AS wordings, array_to_string(list_sort(list(DISTINCT p_brand))[1:4], ',') AS first_wordings, max(p_partkey) AS edited, row_number() OVER (ORDER BY max(p_partkey) DESC) AS place FROM part GROUP BY 1")
def dictionary_listing(spark, root):
    """Expressions with their first wordings, the most recently edited first."""
    g = table(spark, root, "part").groupBy(F.lower("p_type").alias("expr")).agg(F.countDistinct("p_brand").alias("wordings"), F.array_join(F.slice(F.array_sort(F.collect_set("p_brand")), 1, 4), ",").alias("first_wordings"), F.max("p_partkey").alias("edited"))
    places = with_running(g.withColumn("__late", -F.col("edited")), "__late", ["expr"], {}).withColumnRenamed("position", "place")
    return places.drop("__late")


@query("duration_ratios", "SELECT year(o_orderdate) AS y, count(*) FILTER (WHERE o_orderpriority = '1-URGENT')::DOUBLE / count(*) AS urgent_share, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1".replace("count(*) FILTER (WHERE o_orderpriority = '1-URGENT')::DOUBLE / count(*) AS urgent_share", "round(count(*) FILTER (WHERE o_orderpriority = '1-URGENT')::DOUBLE / count(*), 10) AS urgent_share"))
def duration_ratios(spark, root):
    o = table(spark, root, "orders", "o_orderdate", "o_orderpriority", "o_totalprice")
    return o.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.round(F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count("*"), 10).alias("urgent_share"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("seeded_sample")
def seeded_sample(spark, root):
    """A reproducible sample: the 100 rows that hash lowest under a seed."""
    d = table(spark, root, "documents", "doc_id", "lang", "source")
    return d.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(100)


_LETTERS = ", ".join(f"length(x) - length(replace(x, '{c}', ''))" for c in E.LETTERS)


@query("incremental_fill", f"""WITH t AS (SELECT doc_id, trim(coalesce(text, '')) = '' AS blank, {sql_fold('text')} AS x, doc_id % 4 <> 0 AND doc_id % 7 <> 0 AS known FROM documents), v AS (SELECT *, [{_LETTERS}] AS v FROM t),
w AS (SELECT *, sqrt(list_sum(list_transform(v, lambda c: c * c))) AS size FROM v)
SELECT doc_id, NOT blank AND NOT known AS filled, CASE WHEN NOT blank THEN round(CASE WHEN known THEN 1 WHEN size > 0 THEN v[1] / size ELSE 0 END, 9) END AS first_, CASE WHEN NOT blank THEN CASE WHEN known THEN 1 ELSE 26 END END AS dims FROM w""")
def incremental_fill(spark, root):
    """Rows without a vector (a quarter) and rows whose text has changed since (a seventh) are encoded, the others keep the vector they have."""
    d = table(spark, root, "documents", "doc_id", "text")
    crc = F.when(F.col("doc_id") % 7 != 0, F.crc32(F.col("text").cast("binary"))).otherwise(F.lit(1))
    known = d.where("doc_id % 4 != 0").select("doc_id", F.array(F.lit(1.0)).alias("vector"), crc.alias("text_crc"))
    out = E.filled_vectors(d, "doc_id", "text", known)
    return out.select("doc_id", "filled", F.round(F.get("vector", F.lit(0)), 9).alias("first_"), F.when(F.col("vector").isNotNull(), F.size("vector")).cast("long").alias("dims"))


@query("run_log_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def run_log_windows(spark, root):
    """Extension: tumbling windows over the log."""
    out = runlog.windowed_counts(table(spark, root, "events"), "ts", "event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("run_log_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def run_log_sessions(spark, root):
    """Extension: sessions of each user's log, closed after half an hour without a row."""
    out = runlog.sessions(table(spark, root, "events"), "ts", "user_id")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
