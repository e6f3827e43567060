"""A router's answer turned into a filter: validation, fallback, and repair of names against the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import fold
from tessella.operators.similarity import contained_in, similar_pairs
from tessella.sources.tables import written

SECTIONS = ("attributes", "indication", "contraindication", "adverse", "dosing")
ANSWER = "sections array<string>, confidence string, name string, substance string, strength string, freq_rank_max int, rx boolean, reimbursed boolean"
LEAST_RATIO = 0.8


def validated(answer: Column) -> Column:
    """A struct of the answer's filter: what isn't valid is dropped; an answer that can't be read gives an empty filter of low confidence.

    Unknown sections go. With low confidence a single section is no guide, so all are searched; several stay.
    """
    a = F.from_json(answer, ANSWER)
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    known = F.filter(F.coalesce(a["sections"], F.array().cast("array<string>")), lambda s: s.isin(*SECTIONS))
    sure = F.when(F.size(known) == 0, F.lit("low")).otherwise(F.coalesce(F.lower(a["confidence"]), F.lit("low")))
    sections = F.when((F.size(known) == 0) | ((sure == "low") & (F.size(known) < 2)), F.lit(None).cast("array<string>")).otherwise(known)
    return F.struct(
        sections.alias("sections"), sure.alias("confidence"), text(a["name"]).alias("name"), text(a["substance"]).alias("substance"),
        text(F.upper(F.replace(a["strength"], F.lit(" "), F.lit("")))).alias("strength"),
        F.when(a["freq_rank_max"].between(1, 9), a["freq_rank_max"]).alias("freq_rank_max"), a["rx"].alias("rx"), a["reimbursed"].alias("reimbursed"),
    )


def repaired_names(asked: DataFrame, name: str, registry: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """(name, repaired): each distinct name of ``asked`` with the registry's form of it; unknown names stay as they are.

    A name that is part of a registered one is right already. Otherwise the most similar of the whole names and of their
    first words, as many as the name has, takes its place, if the ratio reaches ``least`` (ties by code point). Both
    steps are equi-joins: ``similarity.contained_in`` and ``similarity.similar_pairs``.
    """
    q = asked.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct().withColumn("h", F.trim(fold("name"))).where("h != ''")
    q = q.withColumn("words", F.size(F.split("h", " ")))
    whole = registry.select(F.col("name").alias("form")).where("form IS NOT NULL").distinct()
    words = q.select("words").distinct()  # a handful of word counts
    heads = whole.crossJoin(F.broadcast(words)).select(F.array_join(F.slice(F.split("form", " "), F.lit(1), F.col("words")), " ").alias("form"), "words")
    forms = written(whole.withColumn("words", F.lit(0)).unionByName(heads).distinct().withColumn("f", fold("form")), "name-forms")
    right = q.join(contained_in(q, "h", forms.where("words = 0"), "f").withColumnRenamed("part", "h"), "h", "left_semi").select("name", F.col("name").alias("repaired"))
    right = written(right, "right-names")
    todo = written(q.join(right.select("name"), "name", "left_anti"), "unknown-names")
    near = similar_pairs(todo, "h", forms, "f", least)
    near = todo.select("name", "h", F.col("words").alias("own")).join(near.select(F.col("left").alias("h"), F.col("right").alias("f"), "ratio"), "h")
    near = near.join(forms, "f").where("words = 0 OR words = own")
    best = near.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "form")).alias("b")).select("name", F.col("b.form").alias("repaired"))
    done = right.unionByName(best)
    return asked.select(F.col(name).alias("name")).distinct().join(done, "name", "left").select("name", F.coalesce("repaired", "name").alias("repaired"))
