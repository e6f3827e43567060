"""Dictionary lemmas: affix rules and stems as tables, words reduced by equi-joins, first dictionary that knows a word wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import fold
from tessella.sources.tables import written

RULES = "kind string, flag string, cross boolean, strip string, add string, condition string"


def read_affixes(spark: SparkSession, path: str) -> DataFrame:
    """The rules of an affix file: (kind, flag, cross, strip, add, condition).

    A header line (PFX or SFX, flag, Y or N, number of rules) says whether the flag's prefixes and suffixes go together;
    a rule line has flag, what is stripped from the stem, what is added, and a condition on the stem. ``0`` is empty;
    flags after a slash in what is added are not used; other lines are left out.
    """
    p = F.split(F.regexp_replace(F.trim("value"), r"\s+#.*$", ""), r"\s+")
    lines = spark.read.text(path).select(p.alias("p")).where(F.get("p", F.lit(0)).isin("PFX", "SFX") & (F.size("p") >= 4))
    kind, flag, third, fourth = (F.get("p", F.lit(i)) for i in range(4))
    header = third.isin("Y", "N") & fourth.rlike("^[0-9]+$")
    heads = lines.where(header).select(kind.alias("kind"), flag.alias("flag"), (third == "Y").alias("cross")).distinct()
    none = lambda c: F.when(c == "0", "").otherwise(c)
    rules = lines.where(~header).select(kind.alias("kind"), flag.alias("flag"), none(third).alias("strip"), none(F.split_part(fourth, F.lit("/"), F.lit(1))).alias("add"), F.coalesce(F.get("p", F.lit(4)), F.lit(".")).alias("condition"))
    return rules.join(heads, ["kind", "flag"]).select("kind", "flag", "cross", F.lower("strip").alias("strip"), F.lower("add").alias("add"), F.lower("condition").alias("condition"))


def flag_style(spark: SparkSession, path: str) -> str:
    """How an affix file writes flags: ``char`` (one letter each), ``long`` (two) or ``num`` (numbers and commas)."""
    line = spark.read.text(path).where(F.col("value").rlike(r"^FLAG\s+(long|num)")).first()  # one line of the file
    return line.value.split()[1] if line else "char"


def read_stems(spark: SparkSession, path: str, style: str = "char") -> DataFrame:
    """The stems of a word file, ``word/FLAGS`` a line: (stem, flags). A line that is a number alone (the count on top) is left out."""
    lines = spark.read.text(path).select(F.split_part(F.trim("value"), F.lit("\t"), F.lit(1)).alias("v")).where("v != '' AND NOT v RLIKE '^[0-9]+$'")
    marks = F.split_part("v", F.lit("/"), F.lit(2))
    flags = {"char": F.regexp_extract_all(marks, F.lit("(.)")), "long": F.regexp_extract_all(marks, F.lit("(..)")), "num": F.regexp_extract_all(marks, F.lit("([0-9]+)"))}[style]
    return lines.select(F.lower(F.split_part("v", F.lit("/"), F.lit(1))).alias("stem"), flags.alias("flags")).groupBy("stem").agg(F.array_distinct(F.flatten(F.collect_list("flags"))).alias("flags"))


def read_stop(spark: SparkSession, path: str) -> DataFrame:
    """A stop list, one word a line: (word)."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word != ''").distinct()


def _stripped(forms: DataFrame, rules: DataFrame, kind: str, longest: int, out: str) -> DataFrame:
    """Forms (word, form, ...) with one affix of ``kind`` taken off: (word, ``out``, flag, cross, ...), by an equi-join of their endings (beginnings) with the rules."""
    sizes = F.sequence(F.lit(0), F.least(F.length("form") - 1, F.lit(longest)))
    cut = forms.withColumn("k", F.explode(sizes))
    rest = F.length("form") - F.col("k")
    if kind == "SFX":
        cut = cut.withColumn("add", F.right("form", F.col("k"))).withColumn("base", F.left("form", rest))
        stem, at = F.concat("base", "strip"), F.concat(F.lit("(?:"), "condition", F.lit(")$"))
    else:
        cut = cut.withColumn("add", F.left("form", F.col("k"))).withColumn("base", F.right("form", rest))
        stem, at = F.concat("strip", "base"), F.concat(F.lit("^(?:"), "condition", F.lit(")"))
    some = rules.where(F.col("kind") == kind).select("flag", "cross", "strip", "add", "condition")
    met = cut.join(F.broadcast(some), "add").withColumn(out, stem)  # the rules of an affix file
    return met.where((F.col("condition") == ".") | F.regexp_like(F.col(out), at)).drop("k", "add", "base", "strip", "condition", "form")


def lemmas(words: DataFrame, rules: DataFrame, stems: DataFrame, longest: int = 12) -> DataFrame:
    """Rows (word, lemma): the stems that each distinct word (column ``word``, lower case) is a form of; unknown words have none.

    A word is itself a stem, a stem with a suffix or a prefix of its flags, or with both if both rules allow that. Affixes
    of up to ``longest`` letters are tried. Conditions are patterns of letters and bracketed sets. Null words are left out.
    """
    forms = words.where("isnotnull(word)").select("word").distinct().withColumn("form", F.col("word"))
    known = stems.select(F.col("stem").alias("lemma"), "flags")
    suffixed = _stripped(forms, rules, "SFX", longest, "lemma").select("word", "lemma", F.array("flag").alias("need"), "cross")
    prefixed = _stripped(forms, rules, "PFX", longest, "lemma").select("word", "lemma", F.array("flag").alias("need"))
    inner = suffixed.where("cross").select("word", F.col("lemma").alias("form"), F.col("need").alias("first"))
    both = _stripped(inner, rules, "PFX", longest, "lemma").where("cross").select("word", "lemma", F.concat("first", F.array("flag")).alias("need"))
    itself = forms.select("word", F.col("form").alias("lemma"), F.array().cast("array<string>").alias("need"))
    tried = itself.unionByName(suffixed.drop("cross")).unionByName(prefixed).unionByName(both)
    return tried.join(known, "lemma").where(F.size(F.array_except("need", "flags")) == 0).select("word", "lemma").distinct()


def lexemes(tokens: DataFrame, rules: DataFrame, stems: DataFrame, stop: DataFrame, word: str = "word") -> DataFrame:
    """Tokens through the dictionaries: ``word`` becomes ``term``, one row per lemma; other columns stay.

    The affix dictionary comes first: a word it knows becomes its lemmas, less those on the stop list, and no other
    dictionary sees it. Words it doesn't know lose their accents, and go if the stop list has what is left. Only the
    distinct words go through the rules; their terms are joined back.
    """
    vocabulary = tokens.select(F.lower(word).alias("word")).where("isnotnull(word)").distinct()
    found = lemmas(vocabulary, rules, stems)
    stopped = stop.select(F.col("word").alias("term")).distinct()
    left = vocabulary.join(found.select("word").distinct(), "word", "left_anti").select("word", fold("word").alias("term"))
    terms = found.select("word", F.col("lemma").alias("term")).unionByName(left).join(stopped, "term", "left_anti")
    terms = terms.select(F.col("word").alias("__word"), "term")
    return tokens.join(terms, F.lower(F.col(word)) == F.col("__word")).drop("__word", word)


def special_words(vocabulary: DataFrame, rules: DataFrame, stems: DataFrame, stop: DataFrame) -> DataFrame:
    """(word, terms): of the distinct words of ``vocabulary`` (word, lower case) those whose terms aren't just the word without its accents, see ``lexemes``; a word that goes has none."""
    stopped = stop.select(F.col("word").alias("lemma"), F.lit(True).alias("stopped")).distinct()
    found = lemmas(vocabulary, rules, stems).join(stopped, "lemma", "left")
    known = written(found.groupBy("word").agg(F.array_sort(F.collect_set(F.when(F.col("stopped").isNull(), F.col("lemma")))).alias("terms")), "known-words")
    others = vocabulary.where("isnotnull(word)").join(known.select("word"), "word", "left_anti").select("word", fold("word").alias("lemma"))
    gone = others.join(stopped, "lemma", "left_semi").select("word", F.array().cast("array<string>").alias("terms"))
    return known.unionByName(gone)


def words_of(text: Column) -> Column:
    """Words of letters (with accents) and digits, in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))
