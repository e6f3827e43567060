"""Documents to sections and lines: slicing, heading fill, tables, vocabularies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: characters that recognition confuses with digits, and the words of the frequency scale
CONFUSED = {"0": "0OoQ", "1": "1lI|!", "2": "2Z", "5": "5S", "6": "6G", "8": "8B", "9": "9g"}
FREQUENCY_WORDS = ["velmi časté", "velmi vzácné", "méně časté", "není známo", "vzácné", "časté"]
GROUP_WORDS = r"dosp[eě]l|dosp[ií]vaj|d[eě]t|pediatr|kojen|novorozen|star[sš][ií]|senior"


def number_pattern(number: str) -> str:
    """A section number that tolerates confused digits and spaces round the dots."""
    return "".join(r"\s*\.\s*" if ch == "." else f"[{re.escape(CONFUSED[ch])}]" if ch in CONFUSED else re.escape(ch) for ch in number)


def heading_pattern(number: str, anywhere: bool = False) -> str:
    """A markdown heading with the number at its start, or anywhere in it for merged headings."""
    return rf"(?m)^#{{1,6}}{'[^\n]*?' if anywhere else r'[ \t]*'}{number_pattern(number)}[^0-9\n]"


def slice_section(text: Column, number: str, following: str | None, most: int = 40_000) -> Column:
    """The text from the section's heading to the next section's, else ``most`` characters; null without a heading."""

    def strip(c: Column) -> Column:
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    def cut(anywhere: bool) -> Column:
        at = F.regexp_instr(text, F.lit(heading_pattern(number, anywhere)))
        rest = F.regexp_replace(F.substr(text, at), rf"^#{{1,6}}[^\n]*?{number_pattern(number)}", "")
        if following is None:
            return F.when(at > 0, strip(F.substring(rest, 1, most)))
        end = F.regexp_instr(rest, F.lit(heading_pattern(following, anywhere)))
        return F.when(at > 0, strip(F.when(end > 0, F.substr(rest, F.lit(1), end - 1)).otherwise(F.substring(rest, 1, most))))

    return F.coalesce(cut(False), cut(True))


def has_table(text: Column) -> Column:
    """At least three lines that start with a pipe."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.startswith(F.ltrim(x), F.lit("|")))) >= 3


def cut_annex(text: Column) -> Column:
    """The text before the heading of Annex II (not III)."""
    at = F.regexp_instr(text, F.lit(r"(?im)^#{1,6}[ \t]*p[rřŘ][iíÍ]loha[ \t]+ii([^i\w]|$)"))
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)


def glue_frequency(text: Column) -> Column:
    """Frequency words broken by spaces are joined again, longest first; a capital at the start stays."""
    for word in sorted(FREQUENCY_WORDS, key=lambda w: (-len(w), w)):
        letters = [ch for ch in word if ch != " "]
        loose = r"[ \t]*".join(letters)
        text = F.regexp_replace(text, loose, word)
        text = F.regexp_replace(text, r"[ \t]*".join([letters[0].upper(), *letters[1:]]), word.capitalize())
    return text


def list_to_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*;\s*", "\n")


def table_count(text: Column) -> Column:
    """Markdown tables: separator rows of dashes."""
    return F.regexp_count(text, F.lit(r"(?m)^\|[ \t:|-]*-[ \t:|-]*\|?[ \t]*$"))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))


def fill_group_headings(lines: DataFrame, id_col: str, heading: str = r"^\s*#{1,6}\s*(.*)$", group: str = GROUP_WORDS, refine: str | None = None) -> DataFrame:
    """Add ``group``: the text of the patient-group heading above a line; any other heading resets it.

    With ``refine`` a line under such a heading that matches the pattern (list marks aside) takes the heading's place for the lines
    after it; it counts as a heading itself.
    """
    is_heading = F.col("line").rlike(heading)
    named = F.col("line").rlike(rf"(?i){group}")
    mark = F.when(is_heading, F.when(named, F.trim(F.regexp_replace(F.regexp_extract("line", heading, 1), r"\s*:\s*$", ""))).otherwise(F.lit("")))
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if refine is None:
        return lines.withColumn("group", F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit(""))).withColumn("is_heading", is_heading)
    bare = F.regexp_replace(F.trim("line"), r"^[-* ]+", "")
    marked = lines.withColumn("__mark", mark).withColumn("__under", F.last("__mark", ignorenulls=True).over(w))
    refines = F.coalesce(~is_heading & (F.col("__under") != "") & bare.rlike(refine), F.lit(False))
    marked = marked.withColumn("__refines", refines).withColumn("__mark", F.when(F.col("__refines"), bare).otherwise(F.col("__mark")))
    out = marked.withColumn("group", F.nullif(F.last("__mark", ignorenulls=True).over(w), F.lit(""))).withColumn("is_heading", is_heading | F.col("__refines"))
    return out.drop("__mark", "__under", "__refines")


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word, n, kind): words of four and more letters, and short ones that stand alone three times or more."""
    words = docs.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counts = words.groupBy(id_col, "word").agg(F.count("*").alias("n"))
    kind = F.when(F.length("word") >= 4, "whole").when((F.length("word") >= 2) & (F.col("n") >= 3), "stands")
    return counts.withColumn("kind", kind).where("kind IS NOT NULL")


def coverage(reference: DataFrame, produced: DataFrame, id_col: str) -> DataFrame:
    """(id, coverage): share of the reference's tokens, counted, that the produced text has too; both have (id, token)."""
    n = reference.groupBy(id_col, "token").agg(F.count("*").alias("n"))
    m = produced.groupBy(id_col, "token").agg(F.count("*").alias("m"))
    both = n.join(m, [id_col, "token"], "left")
    return both.groupBy(id_col).agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("coverage"))
