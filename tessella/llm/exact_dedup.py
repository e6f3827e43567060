"""Exact deduplication through an extendible-hash index on shared files (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import documents, drop_table, write_table

SPACE = r"[\x20\x09-\x0D]+"
DEPTH_STEP = 4


def _prefix(depth: int):
    """The first ``depth`` bits of the hash, as a number."""
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(entries: DataFrame, capacity: int, first_depth: int = 2, last_depth: int = 48) -> DataFrame:
    """Leaves (depth, prefix) of the extendible-hash directory: a bucket over ``capacity`` splits on more bits.

    The directory starts with 2^first_depth buckets. While some bucket holds more than ``capacity``
    entries, those buckets double their depth range (four bits at a time) and are counted again; only
    overfull ones go on, so the work is one count per level. At ``last_depth`` a bucket is kept as it is: its
    entries chain. ``entries`` are distinct texts, so copies never overfill a bucket.
    """
    depth, leaves, pending = first_depth, None, entries.select("h")
    while True:
        counts = write_table(pending.groupBy(_prefix(depth).alias("prefix")).agg(F.count("*").alias("n")), "directory")
        done = counts if depth >= last_depth else counts.where(F.col("n") <= capacity)
        level = done.select(F.lit(depth).alias("depth"), "prefix")
        leaves = level if leaves is None else leaves.unionByName(level)
        full = counts.where(F.col("n") > capacity)
        if depth >= last_depth or full.isEmpty():
            return leaves
        pending = pending.withColumn("prefix", _prefix(depth)).join(full.select("prefix"), "prefix", "left_semi").select("h")
        depth = min(depth + DEPTH_STEP, last_depth)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 20_000) -> DataFrame:
    """The index, one entry per distinct normalised text: (depth, prefix, h, chain, text_sha256, keep_id, group_size).

    Texts are grouped by their hash and their bytes together, so equal hashes of different texts stay apart
    (they chain: ``chain`` counts entries of one hash). Copies are combined before the shuffle. Owner tasks
    hold ranges of buckets; their files are sorted by bucket and hash.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, " ")
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).select("id", "norm", F.xxhash64("norm").alias("h"))
    entries = texts.groupBy("h", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = write_table(entries.select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "entries")
    leaves = build_directory(entries, capacity)
    depths = [r.depth for r in leaves.select("depth").distinct().collect()]
    placed = None
    for depth in sorted(depths):  # a leaf's depth says how many bits name it
        part = entries.withColumn("prefix", _prefix(depth)).join(leaves.where(F.col("depth") == depth), "prefix")
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        placed = entries.withColumn("prefix", F.lit(0).cast("long")).withColumn("depth", F.lit(0))
    chain = F.row_number().over(Window.partitionBy("h").orderBy("text_sha256"))
    first = F.expr("shiftleft(prefix, 64 - depth)")
    placed = placed.select("depth", "prefix", "h", chain.alias("chain"), "text_sha256", "keep_id", "group_size", first.alias("first"))
    index = write_table(placed.repartitionByRange("first", "h").sortWithinPartitions("first", "h", "chain").drop("first"), "hash-index")
    drop_table(entries)
    return index


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 20_000) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256), one per row of ``docs``.

    Texts are equal when identical after each run of ASCII white space becomes one space; null counts as
    empty. The row with the smallest id stays. Defined results: empty texts form a group like any
    other; rows that repeat both id and text all carry the same values (``kept`` marks each row whose
    id is the one that stays); a null id never stays unless all ids of the group are null; an empty
    table gives no rows. Other columns are neither read nor returned.
    """
    index = build_index(docs, id_col, text_col, capacity)
    norm = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, " ")
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).select("id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256"))
    return rows.join(index.select("h", "text_sha256", "keep_id", "group_size"), ["h", "text_sha256"]).select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
