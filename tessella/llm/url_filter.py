"""URL filters: rules by host and path, and for the rest trust and distrust that spread over the links of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import drop_table, write_table

#: (host, path, verdict) of the query's rules
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
HREF = r"""href\s*=\s*["']?([^"'\s>]+)"""
ABSOLUTE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
ROUNDS, DAMPING, SHARE = 20, 0.85, 0.4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (host, rules): for each host the rules of itself and of the domains above it, the longest first. An equi-join over the host's endings."""
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    named = rules.select(F.col("host").alias("above"), F.concat("host", "path").alias("rule"), "path", "verdict")
    entry = F.struct((-F.length("rule")).alias("order"), "rule", "path", "verdict")
    return hosts.select("host", F.explode(above).alias("above")).join(named, "above").groupBy("host").agg(F.array_sort(F.collect_list(entry)).alias("rules"))


def link_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """Rows (src, dst, w): on how many pages of a host a link occurs, with both ends named. ``pages`` has ``host``.

    A link to another host is an edge from host to host. A link without a host stays on its own host; if pages
    of two or more hosts hold that same link, its path is a node of its own (it starts with ``/`` or ``:``, as no host does) with
    edges to and from these hosts: sites that share their navigation are neighbours, without any pair of hosts being formed.
    """
    target = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(HREF))))
    links = pages.where("host != ''").select("host", target.alias("target")).groupBy("host", "target").agg(F.count("*").alias("w"))
    links = write_table(links, "links")
    far = F.col("target").rlike(ABSOLUTE)
    to = F.translate(F.regexp_extract("target", "//([^/?#]*)", 1), UPPER, LOWER)
    straight = links.where(far).select(F.col("host").alias("src"), to.alias("dst"), "w").where("src != dst AND dst != ''")
    path = F.regexp_extract("target", "^([^?#]*)", 1)
    near = links.where(~far).select("host", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(":"), path)).alias("node"), "w").where("node != ':'")
    near = near.groupBy("host", "node").agg(F.sum("w").alias("w"))
    shared = near.groupBy("node").agg(F.count("*").alias("hosts")).where("hosts > 1").select("node")
    near = near.join(shared, "node")
    both = straight.unionByName(near.select(F.col("host").alias("src"), F.col("node").alias("dst"), "w")).unionByName(near.select(F.col("node").alias("src"), F.col("host").alias("dst"), "w"))
    out = write_table(both.groupBy("src", "dst").agg(F.sum("w").alias("w")), "host-edges")
    drop_table(links)
    return out


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Rows (node, trust, distrust): personalised PageRank from ``seeds`` (node, trust, distrust), by ``rounds`` rounds of a join.

    Trust follows edges, distrust goes against them: who links to a blocked host is suspect. Both ranks go
    through the same join as rows of two kinds. What reaches a node without onward edges stays there for that round.
    Every fourth round is written to the shared folder; a hub's edges can be split by adaptive execution.
    """
    def shares(kind: str, a: str, b: str) -> DataFrame:
        total = edges.groupBy(F.col(a).alias("node")).agg(F.sum("w").alias("total"))
        return edges.select(F.col(a).alias("node"), F.col(b).alias("to"), "w").join(total, "node").select(F.lit(kind).alias("kind"), "node", "to", (F.col("w") / F.col("total")).alias("share"))

    moves = write_table(shares("trust", "src", "dst").unionByName(shares("distrust", "dst", "src")), "moves")
    stacked = seeds.select("node", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in ("trust", "distrust")))).alias("x")).select("x.kind", "node", "x.score")
    total = stacked.groupBy("kind").agg(F.sum("score").alias("total"))  # two rows
    start = write_table(stacked.join(F.broadcast(total), "kind").where("score > 0").select("kind", "node", (F.col("score") / F.col("total")).alias("score")), "seeds")
    now, written = start, None
    for i in range(1, rounds + 1):
        moved = now.join(moves, ["kind", "node"]).select("kind", F.col("to").alias("node"), (F.col("score") * F.col("share") * damping).alias("score"))
        now = moved.unionByName(start.withColumn("score", F.col("score") * (1 - damping))).groupBy("kind", "node").agg(F.sum("score").alias("score"))
        if i % 4 == 0 or i == rounds:
            before, written = written, write_table(now, "ranks")
            now = written
            if before is not None:
                drop_table(before)
    side = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
    out = now.groupBy("node").agg(side("trust"), side("distrust"))
    drop_table(moves)
    return out


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE) -> DataFrame:
    """Rows (id, host, path, rule, verdict, trust, distrust), one per row of ``pages``.

    ``rules`` (host, path, verdict) fit their host and its subdomains where the path starts with theirs; the longest
    fitting rule decides (of equally long ones the first in code-point order). Pages that rules allow are the seeds of trust, and
    pages that rules block those of distrust, by host; pages without a rule are allowed where
    trust is at least ``share`` of both. Defined results: null urls and such without ``://`` have an empty host and
    path, and hosts that neither rank reaches are unknown: both are allowed; a null html has no links;
    repeated rows each count and each give a row; an empty table gives no rows; other columns are not read.
    """
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).alias("html"))
    hosts = write_table(parsed.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    known = write_table(host_rules(hosts.select("host"), rules), "host-rules")
    hit = F.get(F.filter("rules", lambda r: F.startswith("path", r["path"])), F.lit(0))
    ruled = parsed.join(known, "host", "left").select("id", "host", "path", hit.alias("hit"))
    votes = ruled.where("isnotnull(hit)").groupBy(F.col("host").alias("node")).agg(*(F.count(F.when(F.col("hit.verdict") == v, 1)).cast("double").alias(k) for v, k in (("allow", "trust"), ("block", "distrust"))))
    ranks = spread(link_edges(parsed.select("host", "html"), "html"), votes)
    scored = write_table(hosts.select("host").join(ranks.withColumnRenamed("node", "host"), "host", "left"), "host-ranks")
    full = ruled.join(scored, "host", "left").select(
        "id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("by_rule"), *(F.coalesce(k, F.lit(0.0)).alias(k) for k in ("trust", "distrust"))
    )
    own = F.when(F.col("trust") >= share * (F.col("trust") + F.col("distrust")), "allow").otherwise("block")
    return full.select("id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "trust", "distrust")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _sql(rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    quote = HREF.replace("'", "''")
    steps = "".join(f"""
, s{i} AS MATERIALIZED (SELECT kind, node, sum(score) AS score FROM (
    SELECT kind, m.dest AS node, score * share * {damping} AS score FROM s{i - 1} JOIN moves m USING (kind, node)
    UNION ALL SELECT kind, node, score * {1 - damping} FROM s0) GROUP BY kind, node)""" for i in range(1, rounds + 1))  # fmt: skip
    return f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {values}),
parsed AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, html,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hits AS (SELECT r, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
    FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
ruled AS MATERIALIZED (SELECT p.r, page_id, host, path, rule, verdict FROM parsed p LEFT JOIN (SELECT * FROM hits WHERE k = 1) h ON p.r = h.r),
links AS (SELECT host, target, count(*) AS w FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '{quote}', 1))) AS target FROM parsed WHERE host != '') GROUP BY ALL),
straight AS (SELECT host AS src, translate(regexp_extract(target, '//([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS dst, w FROM links WHERE regexp_matches(target, '{ABSOLUTE}')),
near0 AS (SELECT host, CASE WHEN starts_with(p, '/') THEN p ELSE ':' || p END AS node, sum(w) AS w
    FROM (SELECT host, regexp_extract(target, '^([^?#]*)', 1) AS p, w FROM links WHERE NOT regexp_matches(target, '{ABSOLUTE}')) GROUP BY ALL),
near AS (SELECT * FROM near0 WHERE node != ':' AND node IN (SELECT node FROM near0 GROUP BY node HAVING count(*) > 1)),
edges AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM straight WHERE src != dst AND dst != ''
    UNION ALL SELECT host, node, w FROM near UNION ALL SELECT node, host, w FROM near) GROUP BY src, dst),
moves AS MATERIALIZED (SELECT 'trust' AS kind, src AS node, dst AS dest, w / sum(w) OVER (PARTITION BY src) AS share FROM edges
    UNION ALL SELECT 'distrust', dst, src, w / sum(w) OVER (PARTITION BY dst) FROM edges),
seeds AS (SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host AS node, count(*) AS score FROM ruled WHERE verdict IS NOT NULL GROUP BY ALL),
s0 AS MATERIALIZED (SELECT kind, node, score / sum(score) OVER (PARTITION BY kind) AS score FROM seeds){steps},
ranks AS (SELECT node, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM s{rounds} GROUP BY node)
SELECT page_id, host, path, rule,
    coalesce(verdict, CASE WHEN coalesce(trust, 0) >= {SHARE} * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN ranks ON host = node"""


#: The same rows in DuckDB, each round a table.
OP11_SQL = _sql()
