"""Spelling variants: exact neighbours at one edit through numbered nodes of a forward and a reversed trie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents, drop_table, write_table

#: fixed values: the letters of a run, and those that are put in lower case
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to this length a trie node is known by its string, beyond it by depth and SHA-256.
WHOLE = 64


def runs(docs: DataFrame, id_col: str, text_col: str, shortest: int = 1) -> DataFrame:
    """Rows (id, run): the maximal runs of letters of whole texts that have ``shortest`` code points or more, A-Z in lower case."""
    found = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"([{LETTERS}]{{{shortest},}})"))).alias("run"))
    return found.withColumn("run", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)))


def with_slips(found: DataFrame, every: int = 199) -> DataFrame:
    """Rows (word): the runs; where ``every`` divides the CRC-32 of ``<id>:<run>``, one code point less."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(h % every == 0, short).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """Rows (word, n): words of ``shortest`` code points or more that occur ``least`` times or more, counted by task before the shuffle."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _node(string: Column) -> Column:
    """What tells a node's string apart: itself, or depth and SHA-256 (no letters-only string looks like that)."""
    return F.when(F.length(string) <= WHOLE, string).otherwise(F.concat(F.length(string).cast("string"), F.lit(":"), F.sha2(string.cast("binary"), 256)))


def _numbered_nodes(words: DataFrame, string) -> DataFrame:
    """Rows (word, nodes): the number of the node of ``string(word, i)`` for i from 0 to the word's length.

    Numbers are given once, as the table of distinct nodes is written. The root is 0 and takes part in no join.
    """
    at = words.select("word", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: _node(string(F.col("word"), i)))).alias("i", "node"))
    inner = at.where("node != ''")
    number = write_table(inner.select("node").distinct().select("node", (F.monotonically_increasing_id() + 1).alias("number")), "trie-nodes")
    back = inner.join(number, "node").select("word", "i", "number").unionByName(at.where("node = ''").select("word", "i", F.lit(0).cast("long").alias("number")))
    out = back.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", "number"))).alias("nodes")).select("word", F.col("nodes.number").alias("nodes"))
    out = write_table(out, "word-nodes")
    drop_table(number)
    return out


def node_pairs(words: DataFrame) -> DataFrame:
    """Rows (prefix, suffix, whole, first, word, n): the pair dictionary of a vocabulary (word, n). A written table.

    Skipping code point i of a word pairs the nodes of what stands before and after it (``whole`` false; ``first``
    where the code point before i differs, so that one of the skips with equal results is marked). Between
    two code points the pair makes up the word itself (``whole`` true): there one can be inserted.
    """
    before = _numbered_nodes(words, lambda w, i: F.substring(w, F.lit(1), i))
    after = _numbered_nodes(words, lambda w, i: F.substring(w, i + 1, F.length(w)))
    both = words.join(before.withColumnRenamed("nodes", "p"), "word").join(after.withColumnRenamed("nodes", "s"), "word")
    letter = lambda i: F.substring("word", i, F.lit(1))
    skips = F.transform(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: F.struct(F.get("p", i - 1).alias("prefix"), F.get("s", i).alias("suffix"), F.lit(False).alias("whole"), ((i == 1) | (letter(i) != letter(i - 1))).alias("first")),
    )
    gaps = F.transform(F.sequence(F.lit(0), F.length("word")), lambda i: F.struct(F.get("p", i).alias("prefix"), F.get("s", i).alias("suffix"), F.lit(True).alias("whole"), F.lit(False).alias("first")))
    out = write_table(both.select("word", "n", F.explode(F.concat(skips, gaps)).alias("k")).select("k.*", "word", "n"), "node-pairs")
    drop_table(before)
    drop_table(after)
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """Rows (word, n_near, best): how many words of the vocabulary (word, n) differ by one edit, and the most frequent of them.

    Words that share a pair by a skip differ in the code point skipped; a word whose own gap has that pair is
    each of them without it. A pair belongs to one string, so it has one such word at most and, by skips, as many words
    as there are letters: the lists collected here can't grow with the data. Every two near words
    meet under one pair that counts. ``best`` is (-n, word).
    """
    pairs = node_pairs(words)
    entry = F.struct((-F.col("n")).alias("m"), "word", "first")
    groups = pairs.groupBy("prefix", "suffix").agg(
        F.array_sort(F.collect_list(F.when(~F.col("whole"), entry))).alias("skips"), F.max(F.when(F.col("whole"), F.struct((-F.col("n")).alias("m"), "word"))).alias("whole")
    )
    groups = groups.where("size(skips) > 1 OR (size(skips) = 1 AND isnotnull(whole))")
    plain = lambda x: F.struct(x["m"].alias("m"), x["word"].alias("word"))
    kind = "struct<m:bigint,word:string>"
    shortened = F.col("whole").isNotNull()

    def of_skip(x: Column) -> Column:
        other = F.when(F.element_at("skips", 1)["word"] != x["word"], plain(F.element_at("skips", 1))).otherwise(plain(F.get("skips", F.lit(1))))
        other = F.when(F.size("skips") > 1, other).cast(kind)
        fits = shortened & x["first"]
        best = F.when(other.isNull() | (fits & (F.col("whole") < other)), F.col("whole").cast(kind)).otherwise(other)
        return F.struct(x["word"].alias("word"), (F.size("skips") - 1 + fits.cast("int")).alias("k"), F.when((F.size("skips") > 1) | fits, best).alias("best"))

    first = F.filter("skips", lambda x: x["first"])
    of_whole = F.struct(F.col("whole.word").alias("word"), F.size(first).alias("k"), plain(F.get(first, F.lit(0))).alias("best"))
    found = groups.select(F.explode(F.concat(F.transform("skips", of_skip), F.when(shortened, F.array(of_whole)).otherwise(F.array().cast(f"array<struct<word:string,k:int,best:{kind}>>")))).alias("x")).select("x.*")
    out = write_table(found.where("k > 0").groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best")), "near-words")
    drop_table(pairs)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root): where the chain of (word, form) ends, by pointer doubling. Forms are more frequent than their words, so no chain is a ring."""
    now = write_table(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        longer = now.select("word", "root").join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved"))
        before, now = now, write_table(longer, "roots")
        drop_table(before)
    return now.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    A word's form is its most frequent neighbour (ties: the first in code-point order) if that occurs at least
    ``ratio`` times as often. Defined results: a word without neighbours has none and is its own root; an empty
    vocabulary gives an empty table; null words are left out; words of any length take part (beyond 64 code points nodes
    are told apart by SHA-256).
    """
    words = write_table(words.where("isnotnull(word)").select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    near = neighbours(words)
    full = words.join(near, "word", "left")
    fits = -F.col("best.m") >= ratio * F.col("n")
    full = full.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))
    ends = roots(full.where("isnotnull(form)"))
    return full.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(with_slips(runs(documents(spark, sf_dir), "doc_id", "text", 6))))
