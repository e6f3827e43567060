"""Sharding by balanced label propagation: linked documents meet in one shard, row counts stay even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import documents, drop_table, write_table

CHUNK_ROWS = 20_000


def ranked_within(rows: DataFrame, by: list[str], chunk: str, order: list[str], name: str, where: Column | None = None) -> DataFrame:
    """Add a gapless 0-based rank within ``by``, ordered by chunk and then ``order``.

    ``chunk`` splits every group into pieces of bounded size: pieces are ranked by themselves and start
    where the counts of the pieces before them end, so a group of any size is spread over many tasks.
    """
    counts = rows.groupBy(*by, chunk).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over((Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*by, chunk, F.coalesce(before, F.lit(0)).alias("__start"))
    local = rows.withColumn("__local", F.row_number().over(Window.partitionBy(*by, chunk).orderBy(*order)) - 1)
    return local.join(starts, [*by, chunk]).withColumn(name, F.col("__start") + F.col("__local")).drop("__start", "__local")


def targets(total: int, shards: int) -> list[int]:
    """Rows each shard must have: counts differ by one at most."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def propagate(nodes: DataFrame, members: DataFrame, want: list[int], rounds: int, fill: float = 0.95) -> DataFrame:
    """Move linked rows towards the shards of their neighbours: rows (rid, shard) for the rows in ``members``.

    ``nodes`` has (rid, shard), ``members`` (rid, link): rows of one link are neighbours. In each round every link takes the
    label with most votes among its members' shards that still have room, every row the label that most of its links
    propose, and moves are admitted by link with the probability that fits the target's room, so quotas hold
    without ranking all movers in one place. Rounds end when nothing moves.
    """
    spark, shards = nodes.sparkSession, len(want)
    state = write_table(nodes.join(members.select("rid").distinct(), "rid", "left_semi").select("rid", "shard"), "labels")
    for r in range(rounds):
        load = {x.shard: x.n for x in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
        room = [max(0.0, fill * want[s] - load.get(s, 0)) for s in range(shards)]
        open_ = F.element_at(F.array(*[F.lit(float(x) / max(1, w)) for x, w in zip(room, want)]), F.col("shard") + 1)
        votes = members.join(state, "rid").groupBy("link", "shard").agg(F.count("*").alias("n"))
        pull = F.struct((F.col("n") * (F.lit(0.01) + open_)).alias("w"), (-F.xxhash64("link", "shard", F.lit(r))).alias("tie"), F.col("shard").alias("s"))
        labels = votes.groupBy("link").agg(F.max(pull).alias("best"), F.sum("n").alias("size")).select("link", F.col("best.s").alias("label"), "size")
        wish = members.join(labels, "link").groupBy("rid", "label").agg(F.sum("size").alias("w"), F.min("link").alias("via"))
        best = F.max(F.struct("w", (-F.col("label")).alias("label"), "via")).alias("b")
        wish = wish.groupBy("rid").agg(best).select("rid", (-F.col("b.label")).alias("label"), F.col("b.via").alias("via"))
        moves = write_table(state.join(wish, "rid"), "wishes")
        inward = {x.label: x.n for x in moves.where("label != shard").groupBy("label").agg(F.count("*").alias("n")).collect()}
        outward = {x.shard: x.n for x in moves.where("label != shard").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        if not inward:
            drop_table(moves)
            break
        admit = []
        for s in range(shards):  # rows that leave make room, as far as they are sure to be let in elsewhere: half of them
            free = fill * want[s] - load.get(s, 0) + 0.5 * outward.get(s, 0)
            admit.append(min(1.0, max(0.0, free) / inward[s]) if s in inward else 0.0)
        p = F.element_at(F.array(*[F.lit(x) for x in admit]), F.col("label") + 1)
        chance = F.pmod(F.xxhash64("via", F.lit(r)), F.lit(1_000_003)) / 1_000_003.0
        shard = F.when((F.col("label") != F.col("shard")) & (chance < p), F.col("label")).otherwise(F.col("shard"))
        before, state = state, write_table(moves.select("rid", shard.alias("shard")), "labels")
        drop_table(before)
        drop_table(moves)
    return state


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6, links: DataFrame | None = None) -> DataFrame:
    """Rows (id, size, text_crc32, law, shard, slot, grown_shard): law ``rows``, so shard counts differ by one at most.

    Linked documents (equal texts, or rows (id, link) given as ``links``) move towards each other by ``propagate``; a link of
    more than half a shard is split into blocks of that size first. Rows above a shard's quota and rows
    without links then fill the shards to their exact counts. Defined results: size is the UTF-8 length
    plus 8, a null text counting none and having crc32 null and no link; repeated rows are rows of
    their own; null ids are placed like others; an empty table gives no rows; fewer rows than shards
    leave shards empty. Other columns are neither read nor returned.
    """
    text = F.col(text_col).cast("string")
    raw = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("link"),
    )
    raw = write_table(raw, "shard-rows")
    total = raw.count()
    want, chunks = targets(total, shards), max(1, total // CHUNK_ROWS)
    mixed = F.xxhash64("id", "link", "text_crc32")
    rows = raw.withColumn("chunk", F.pmod(mixed, F.lit(chunks)).cast("int"))
    rows = ranked_within(rows, [], "chunk", ["id", "link", "size"], "rid")
    rows = write_table(rows.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")), "shard-rows")
    drop_table(raw)
    linked = rows.select("rid", "link").where("link IS NOT NULL") if links is None else rows.join(links.select(F.col("id"), F.col("link").cast("binary").alias("l")), "id").select("rid", F.col("l").alias("link"))
    sizes = linked.groupBy("link").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(max(1, want[-1] // 2)))
    members = linked.join(sizes, "link").select("rid", F.xxhash64("link", F.pmod(F.xxhash64("rid"), blocks)).alias("link"))
    members = write_table(members, "links")
    placed = propagate(rows.select("rid", "shard"), members, want, rounds)
    # a shard keeps linked rows up to its count; the others fill what is left, in order of their rank
    state = rows.drop("shard").join(placed, "rid", "left")
    held = ranked_within(state.where("shard IS NOT NULL"), ["shard"], "chunk", ["rid"], "at")
    quota = F.element_at(F.array(*[F.lit(w) for w in want]), F.col("shard") + 1)
    held = held.withColumn("shard", F.when(F.col("at") < quota, F.col("shard"))).drop("at")
    held = write_table(held.unionByName(state.where("shard IS NULL")), "shard-state")
    load = {x.shard: x.n for x in held.where("shard IS NOT NULL").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    rest = ranked_within(held.where("shard IS NULL"), [], "chunk", ["rid"], "at")
    fill, end = F.lit(shards - 1), 0
    ends = []
    for s in range(shards):
        end += want[s] - load.get(s, 0)
        ends.append(end)
    for s in reversed(range(shards - 1)):
        fill = F.when(F.col("at") < ends[s], F.lit(s)).otherwise(fill)
    rest = rest.withColumn("shard", fill).drop("at")
    out = write_table(held.where("shard IS NOT NULL").unionByName(rest), "shard-state")
    out = ranked_within(out, ["shard"], "chunk", ["id", "rid"], "slot")
    return out.select("id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
