"""Exact joins of similar strings: prefix filtering over letters, bounds on the JVM, and the ratio itself for what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.python import gestalt_ratio


def _needed(size: Column, least: float) -> Column:
    """Letters that a string of this length shares at least with any string of ratio ``least`` or more.

    The gestalt ratio is 2 M / (a + b), and its M matched letters are common to both as multisets; so b is at least
    a · least / (2 - least), and M at least that much too. The small step down keeps rounding on the safe side.
    """
    return F.greatest(F.ceil(size * (least / (2 - least)) - 1e-9), F.lit(1))


def _letters(text: Column) -> Column:
    """The letters of a string, numbered where they repeat: its multiset as a set. ``aba`` is a0, b0, a1."""
    each = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.transform(each, lambda c, i: F.struct(c.alias("c"), (i - F.array_position(each, c).cast("int") + 1).alias("k")))


def similar_pairs(left: DataFrame, left_col: str, right: DataFrame, right_col: str, least: float) -> DataFrame:
    """Rows (left, right, ratio): all pairs of distinct strings whose gestalt ratio is at least ``least`` (above 0), exactly.

    Letters are put in order, rare ones first. Of a string that must share s of its n letters, the first n - s + 1
    hold a shared one, and the first n - s + 2 hold two of them; so candidates are joined by pairs of letters out of that
    prefix, or by one letter where strings are too short to have to share two. What meets is held against the
    lengths and the number of common letters (both on the JVM) before the ratio is computed. Null and empty strings
    have no partner; a pair counts from ``left`` to ``right``, as the ratio depends on the order.
    """
    a = left.select(F.col(left_col).alias("s")).where("s IS NOT NULL AND s != ''").distinct().withColumn("side", F.lit(0))
    b = right.select(F.col(right_col).alias("s")).where("s IS NOT NULL AND s != ''").distinct().withColumn("side", F.lit(1))
    both = a.unionByName(b).withColumn("letters", _letters(F.col("s")))
    # numbered letters: as many as the alphabet has, times the repeats in one string
    counts = both.select(F.explode("letters").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    order = counts.agg(F.map_from_entries(F.collect_list(F.struct("x", "n"))).alias("frequency"))
    ranked = both.crossJoin(F.broadcast(order)).select(  # one row
        "side", "s", F.length("s").alias("n"), F.transform(F.array_sort(F.transform("letters", lambda x: F.struct(F.element_at("frequency", x).alias("f"), x.alias("x")))), lambda x: x["x"]).alias("letters")
    )
    need = _needed(F.col("n"), least)
    # a string that has to share one letter only has partners up to this length: they offer single letters too
    share = (2 - least) / least
    short = int(share * int(share + 1e-9) + 1e-9)
    one = F.slice("letters", F.lit(1), (F.col("n") - need + 1).cast("int"))
    two = F.slice("letters", F.lit(1), F.least(F.col("n") - need + 2, F.col("n")).cast("int"))
    nothing = F.struct(F.lit("").alias("c"), F.lit(0).alias("k"))
    singles = F.when(F.col("n") <= short, F.transform(one, lambda x: F.struct(x.alias("x"), nothing.alias("y"))))
    pairs = F.when(need > 1, F.flatten(F.transform(two, lambda x, i: F.transform(F.slice(two, i + 2, F.size(two)), lambda y: F.struct(x.alias("x"), y.alias("y"))))))
    none = F.array().cast("array<struct<x:struct<c:string,k:int>,y:struct<c:string,k:int>>>")
    keyed = ranked.select("side", "s", "n", "letters", F.explode(F.concat(F.coalesce(singles, none), F.coalesce(pairs, none))).alias("key"))
    l = keyed.where("side = 0").select(F.col("s").alias("left"), F.col("n").alias("ln"), F.col("letters").alias("ll"), "key")
    r = keyed.where("side = 1").select(F.col("s").alias("right"), F.col("n").alias("rn"), F.col("letters").alias("rl"), "key")
    total = F.col("ln") + F.col("rn")
    enough = lambda common: 2 * common >= total * least - 1e-9
    met = l.join(r, "key").where(enough(F.least("ln", "rn"))).where(enough(F.size(F.array_intersect("ll", "rl"))))
    return met.select("left", "right").distinct().withColumn("ratio", gestalt_ratio("left", "right")).where(F.col("ratio") >= least)


def occurrences(parts: DataFrame, part_col: str, wholes: DataFrame, whole_col: str, gram: int = 3) -> DataFrame:
    """Rows (part, whole): the distinct strings of ``parts`` with each distinct string of ``wholes`` that they occur in.

    One piece of each part, the one in the fewest wholes, is looked up among the pieces of the wholes by equality; only those that meet
    are searched. Strings shorter than ``gram`` are pieces themselves.
    """
    p = parts.select(F.col(part_col).alias("part")).where("part IS NOT NULL AND part != ''").distinct().withColumn("k", F.least(F.length("part"), F.lit(gram)))
    w = wholes.select(F.col(whole_col).alias("whole")).where("whole IS NOT NULL AND whole != ''").distinct()
    pieces = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, k)))
    sizes = p.select("k").distinct()  # at most ``gram`` rows
    held = w.crossJoin(F.broadcast(sizes)).where(F.length("whole") >= F.col("k")).select("whole", F.explode(pieces(F.col("whole"), F.col("k"))).alias("piece"))
    often = held.groupBy("piece").agg(F.count("*").alias("n"))
    cut = p.select("part", pieces(F.col("part"), F.col("k")).alias("pieces")).select("part", F.size("pieces").alias("all"), F.explode("pieces").alias("piece"))
    chosen = cut.join(often, "piece").groupBy("part", "all").agg(F.min(F.struct("n", "piece")).alias("m"), F.count("*").alias("met"))
    chosen = chosen.where("met = all").select("part", F.col("m.piece").alias("piece"))  # else some piece is in no whole
    return chosen.join(held, "piece").where(F.contains("whole", "part")).select("part", "whole")


def contained_in(parts: DataFrame, part_col: str, wholes: DataFrame, whole_col: str) -> DataFrame:
    """Rows (part): the distinct strings of ``parts`` that occur somewhere in a string of ``wholes``."""
    return occurrences(parts, part_col, wholes, whole_col).select("part").distinct()
