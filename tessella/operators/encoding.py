"""Vectors for rows that have none: an encoder behind one interface, called for what is new or changed only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import fold

#: (rows with id and text) -> (id, vector); a model's encoder would use ``mapInPandas``
Encoder = Callable[[DataFrame, str, str], DataFrame]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_vector(text: Column) -> Column:
    """Shares of the letters a to z in the folded text, scaled to length one; zeros for a text without letters. It stands in for a model."""

    def counts(t: Column) -> Column:
        return F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])

    def scaled(v: Column) -> Column:
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0)))

    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    return once(once(fold(text), counts), scaled)


def letter_encoder(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(id_col, letter_vector(F.col(text_col)).alias("vector"))


def filled_vectors(rows: DataFrame, id_col: str, text_col: str, known: DataFrame, encode: Encoder = letter_encoder) -> DataFrame:
    """(id, vector, text_crc, filled): the known vector of each row whose text is still the one it was made of; the others are encoded.

    ``known`` has (id, vector, text_crc). Null and blank texts get no vector. ``filled`` tells which rows the encoder was called for; it sees those
    rows only, and vectors of rows that are gone are left out.
    """
    now = rows.select(id_col, text_col, F.crc32(F.col(text_col).cast("binary")).alias("crc"))
    met = now.join(known.select(id_col, "vector", "text_crc"), id_col, "left")
    fresh = F.col("vector").isNotNull() & F.col("crc").eqNullSafe(F.col("text_crc"))
    blank = F.coalesce(F.trim(text_col), F.lit("")) == ""
    kept = met.where(fresh & ~blank).select(id_col, "vector", F.col("crc").alias("text_crc"), F.lit(False).alias("filled"))
    todo = met.where(~fresh & ~blank).select(id_col, text_col, "crc")
    new = encode(todo.select(id_col, text_col), id_col, text_col).join(todo.select(id_col, "crc"), id_col).select(id_col, "vector", F.col("crc").alias("text_crc"), F.lit(True).alias("filled"))
    none = met.where(blank).select(id_col, F.lit(None).cast(dict(known.dtypes)["vector"]).alias("vector"), F.col("crc").alias("text_crc"), F.lit(False).alias("filled"))
    return kept.unionByName(new).unionByName(none)
