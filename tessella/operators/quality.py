"""Data-quality checks over extracted items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def section_coverage(codes: DataFrame, items: DataFrame, key: str, section: str, expected: list[str]) -> DataFrame:
    """Keys that lack one of the expected sections: (key, present, missing). Left outer join, so keys without items count."""
    g = codes.select(key).join(items.select(key, section), key, "left").groupBy(key).agg(F.array_sort(F.collect_set(section)).alias("present"))
    missing = F.array_except(F.array(*[F.lit(s) for s in sorted(expected)]), "present")
    return g.select(key, "present", missing.alias("missing")).where(F.size("missing") > 0)


def suspicious(rows: DataFrame, keys: list[str], text: str, most_items: int, most_chars: int) -> DataFrame:
    """Groups with too many items or an overlong one."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("items"), F.max(F.length(text)).alias("longest"))
    return g.where((F.col("items") > most_items) | (F.col("longest") > most_chars))


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(total, distinct, duplicates) with nulls equal to each other; counted in two steps, so no task holds all keys."""
    groups = rows.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_rows")).withColumn("duplicates", F.col("total") - F.col("distinct_rows"))


def unify_key(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(text, key): the most frequent key of equal texts; ties by length, then by value."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(text, key).agg(F.count("*").alias("n"))
    w = Window.partitionBy(text).orderBy(F.desc("n"), F.length(key), key)
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select(text, key)


def canonical_json(c: Column) -> Column:
    """One spelling of a JSON value: keys in order at every depth, no white space, arrays as they are; null if it can't be read.

    The value is parsed to a variant, which holds the fields of an object by key. Objects that name a key twice can't be read.
    It is parsed as the only element of an array, so what stands after it is an error and not left out.
    """
    only = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    text = F.to_json(only)
    return F.when((text != "[]") & F.variant_get(only, "$[1]", "variant").isNull(), F.substring(text, F.lit(2), F.length(text) - 2))


def unique_objects(rows: DataFrame, by: list[str], json_col: str, order: str) -> DataFrame:
    """The first row, by ``order``, of each distinct object within ``by``; adds ``canonical`` and ``broken``.

    Objects are equal whatever the order of their keys. What isn't JSON stays, every row of it, and is marked; nulls stay
    too, unmarked. Rows meet by a hash of the canonical form and by the form itself.
    """
    marked = rows.withColumn("canonical", canonical_json(F.col(json_col))).withColumn("broken", F.col("canonical").isNull() & F.col(json_col).isNotNull())
    first = marked.where("canonical IS NOT NULL").withColumn("__h", F.xxhash64("canonical"))
    w = Window.partitionBy(*by, "__h", "canonical").orderBy(order)
    kept = first.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__h")
    return kept.unionByName(marked.where("canonical IS NULL"))


def changed_keys(rows: DataFrame, id_col: str, text: str, key: str) -> DataFrame:
    """(id, old, new): rows whose key differs from their text's unified one."""
    best = unify_key(rows, text, key).select(text, F.col(key).alias("new"))
    return rows.join(best, text).where(~F.col("new").eqNullSafe(F.col(key))).select(id_col, F.col(key).alias("old"), "new")


def rare_class(rows: DataFrame, term: str, cls: str, holder: str, least_holders: int, rare: float, dominant: float) -> DataFrame:
    """(term, class, holders, share, top): classes that are rare for a term which another class clearly owns."""
    pairs = rows.select(term, cls, holder).distinct().groupBy(term, cls).agg(F.count("*").alias("holders"))
    spread = rows.select(term, holder).distinct().groupBy(term).agg(F.count("*").alias("all_holders")).where(F.col("all_holders") >= least_holders)
    w = Window.partitionBy(term)
    shares = pairs.withColumn("total", F.sum("holders").over(w)).withColumn("most", F.max("holders").over(w)).join(spread, term, "left_semi")
    bad = shares.where((F.col("most") / F.col("total") >= dominant) & (F.col("holders") / F.col("total") < rare))
    return bad.select(term, cls, "holders", (F.col("holders") / F.col("total")).alias("share"))


def fragment_reason(text: Column, longest_neighbour: Column) -> Column:
    """Why an item looks like a piece of a sentence: a preposition, an inflected first word, or short beside a long one."""
    first = F.lower(F.regexp_replace(F.split_part(text, F.lit(" "), F.lit(1)), r"^[(,]+|[(,]+$", ""))
    words = F.size(F.split(text, r"\s+"))
    small = F.substring(text, 1, 1) != F.upper(F.substring(text, 1, 1))
    return (
        F.when(first.rlike("^(u|s|se|při|pro|po|ke|k|v|ve|z|ze|of|in|with|de|en|von|mit)$"), "preposition")
        .when(first.rlike(r"^[\p{L}-]+(em|ou|ami|ech|ím|ými|ích|ého|ému|ým)$") & small, "inflected")
        .when((words <= 2) & (longest_neighbour >= 8), "short")
    )


def longest_other(n: str, by: list[str], id_col: str) -> Column:
    """The largest ``n`` in the group other than the row's own (ties keep it), without a self join."""
    w = Window.partitionBy(*by)
    top = F.max(n).over(w)
    # the second largest, should the row itself be the largest
    second = F.nth_value(n, 2).over(w.orderBy(F.desc(n), id_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.row_number().over(w.orderBy(F.desc(n), id_col)) == 1
    return F.when(first, second).otherwise(top)
