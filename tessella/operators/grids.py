"""Tables of converted documents as grids of cells, and how far the columns of two versions agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.text import fold, squeeze
from tessella.operators.normalize import CANON

_GRID = "array<array<string>>"


def markdown_grids(text: Column) -> Column:
    """Tables of a markdown text: an array of tables, each an array of rows of cells. Separator rows are left out; any other line ends a table."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kind = f"array<{_GRID}>"
    state = f"struct<open:boolean,tables:{kind}>"

    def step(s: Column, x: Column) -> Column:
        row = x.rlike(r"^\|.*\|$")
        cells = F.transform(F.split(F.substring(x, F.lit(2), F.length(x) - 2), "[|]"), lambda c: F.trim(c))
        rule = F.forall(cells, lambda c: c.rlike("^(:?-{2,}:?)?$"))
        last = F.coalesce(F.try_element_at(s["tables"], F.lit(-1)), F.array().cast(_GRID))
        longer = F.concat(F.slice(s["tables"], F.lit(1), F.size(s["tables"]) - 1), F.array(F.concat(last, F.array(cells))))
        more = F.when(s["open"], longer).otherwise(F.concat(s["tables"], F.array(F.array(cells))))
        return F.when(~row, F.struct(F.lit(False).alias("open"), s["tables"].alias("tables"))).when(rule, s).otherwise(F.struct(F.lit(True).alias("open"), more.alias("tables"))).cast(state)

    return F.aggregate(lines, F.struct(F.lit(False).alias("open"), F.array().alias("tables")).cast(state), step, lambda s: s["tables"])


def _span(attributes: Column, name: str) -> Column:
    return F.greatest(F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(attributes, rf"(?i){name}\s*=\s*[\"']?([0-9]{{1,3}})", 1), F.lit("")), F.lit("999")).cast("int"), F.lit(1)), F.lit(1))


def html_grids(html: Column) -> Column:
    """Tables of an HTML text as grids: a cell that spans columns or rows is repeated in each place it covers.

    One fold over the rows of a table carries the cells that reach into the next row; within a row, one over its columns takes such a
    cell or the next of the row's own. Tables inside tables aren't told apart.
    """
    place = "struct<text:string,left:int>"
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"))
    rows = lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?:</tr>|$)"))

    def units(row: Column) -> Column:
        cells = F.regexp_extract_all(row, F.lit(r"(?is)(<t[dh]\b[^>]*>.*?)(?:</t[dh]>|(?=<t[dh]\b)|$)"))
        one = lambda c: F.struct(squeeze(F.regexp_replace(c, "<[^>]*>", " ")).alias("text"), _span(F.regexp_extract(c, r"^<([^>]*)>", 1), "rowspan").alias("left"))
        return F.flatten(F.transform(cells, lambda c: F.array_repeat(one(c), _span(F.regexp_extract(c, r"^<([^>]*)>", 1), "colspan"))))

    def filled(held: Column, own: Column) -> Column:
        still = F.size(F.filter(held, lambda h: h["left"] > 0))
        width = F.greatest(F.size(held), F.size(own) + still)
        kind = f"struct<out:array<{place}>,next:int>"

        def column(a: Column, i: Column) -> Column:
            above, cell = F.get(held, i), F.get(own, a["next"])
            takes = F.coalesce(above["left"] > 0, F.lit(False))
            new = F.when(takes, F.struct(above["text"].alias("text"), (above["left"] - 1).alias("left"))).otherwise(F.struct(F.coalesce(cell["text"], F.lit("")).alias("text"), F.coalesce(cell["left"] - 1, F.lit(0)).alias("left")))
            return F.struct(F.concat(a["out"], F.array(new)).alias("out"), (a["next"] + (~takes).cast("int")).alias("next")).cast(kind)

        places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.struct(F.array().alias("out"), F.lit(0).alias("next")).cast(kind), column, lambda a: a["out"])

    state = f"struct<held:array<{place}>,rows:{_GRID}>"

    def row(s: Column, r: Column) -> Column:
        now = F.get(F.transform(F.array(units(r)), lambda own: filled(s["held"], own)), F.lit(0))  # the row is cut once
        return F.get(F.transform(F.array(now), lambda n: F.struct(n.alias("held"), F.concat(s["rows"], F.array(F.transform(n, lambda c: c["text"]))).alias("rows")).cast(state)), F.lit(0))

    start = F.struct(F.array().alias("held"), F.array().alias("rows")).cast(state)
    return F.transform(tables, lambda t: F.aggregate(rows(t), start, row, lambda s: s["rows"]))


def heading_frequency(cell: Column) -> Column:
    """The wording of the frequency scale that a cell begins with, null for none."""
    plain = F.regexp_replace(squeeze(fold(F.regexp_replace(cell, "[*#]", ""))), "^[ :]+|[ :]+$", "")

    def named(p: Column) -> Column:
        out = F.lit(None).cast("string")
        for name in sorted(CANON.values(), key=len):
            out = F.when(p.startswith(fold(F.lit(name))), F.lit(name)).otherwise(out)
        return out

    return F.get(F.transform(F.array(plain), named), F.lit(0))


def column_words(docs: DataFrame, id_col: str, grids: str) -> DataFrame:
    """Rows (id, frequency, word, n): words of three letters or more under each frequency of the tables (column ``grids``).

    A row with two frequencies or more is a heading for the rows below it, up to the next heading or the end of its table. A row that says the
    same in all its cells names a group, and cells that hold a frequency are none of the words.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(grids).alias("t", "grid")).select("id", "t", F.posexplode("grid").alias("r", "cells"))
    named = rows.withColumn("marks", F.transform("cells", heading_frequency))
    heads = F.when(F.size(F.array_compact("marks")) >= 2, F.col("marks"))
    w = Window.partitionBy("id", "t").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the rows of one table
    under = named.withColumn("is_head", heads.isNotNull()).withColumn("head", F.last(heads, ignorenulls=True).over(w)).where("NOT is_head AND head IS NOT NULL")
    distinct = F.array_distinct(F.filter(F.transform("cells", lambda c: F.lower(c)), lambda c: c != ""))
    cells = under.where(F.size(distinct) > 1).select("id", F.explode(F.arrays_zip("cells", "marks", "head")).alias("c"))
    words = cells.where("c.head IS NOT NULL AND c.marks IS NULL AND c.cells IS NOT NULL").select("id", F.col("c.head").alias("frequency"), F.explode(F.regexp_extract_all(F.lower("c.cells"), F.lit(r"(\p{L}{3,})"))).alias("word"))
    return words.groupBy("id", "frequency", "word").agg(F.count("*").alias("n"))


def column_agreement(reference: DataFrame, produced: DataFrame) -> DataFrame:
    """(id, words, correct, elsewhere, missing) of the reference's words, from ``column_words`` of both versions.

    Words count as often as they occur: correct under the same frequency, elsewhere if the produced tables have them under another
    one, missing if not at all. Documents without reference words have no row.
    """
    n, m = reference.withColumnRenamed("n", "n"), produced.withColumnRenamed("n", "m")
    right = n.join(m, ["id", "frequency", "word"], "left").groupBy("id", "word").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("ok"))
    there = m.groupBy("id", "word").agg(F.sum("m").alias("m"))
    each = right.join(there, ["id", "word"], "left").withColumn("elsewhere", F.least("n", F.coalesce("m", F.lit(0))) - F.col("ok"))
    out = each.groupBy("id").agg(F.sum("n").alias("words"), F.sum("ok").alias("correct"), F.sum("elsewhere").alias("elsewhere"))
    return out.withColumn("missing", F.col("words") - F.col("correct") - F.col("elsewhere"))
