"""Sections cut to their core before extraction, and patient groups written to the items below their heading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.operators.sections import GROUP_WORDS, has_table, list_to_lines

# fixed values: beginnings of the sub-headings after which the core of a section is over, and what a dose looks like
DOSING_ENDS = "starší|pediatr|děti|porucha funkce|poruch[ay] ledvin|poruch[ay] jater|zvláštní populace|způsob pod|renální|hepatální|snížená funkce"
ADVERSE_ENDS = "popis vybran|hlášení podezření|pediatr|další informace|dlouhodobé užívání|zvláštní populace|starší"
REPORTING = "hlášení podezření"
FREQUENCY_LINE = r"(?iu)^(velmi\s+časté|časté|méně\s+časté|velmi\s+vzácné|vzácné|není\s+známo)\s*:"
DOSE = r"(?iu)\d[\d,.\s-]*\s*(mg|g|ml|mcg|µg|mikrogram|tablet|kapsl|vstřik|kapk|dávk|%)"
REFINEMENT = r"(?iu)^\s*(d[ěe]ti[^.]{0,60}|dosp[ěe]l[íi][^.]{0,40}|dosp[íi]vaj[íi]c[íi][^.]{0,40})\s*$"
LEAST_CORE, LONGEST_HEADING = 250, 90


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _opens(words: str) -> str:
    """A line that begins with one of these words, with or without heading marks."""
    return rf"(?iu)^\s*#{{0,6}}\s*({words})"


def _once(value: Column, then) -> Column:
    """``then`` of a value that is computed once, though it is used often."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _from(lines: Column, first: Column) -> Column:
    return F.array_join(F.slice(lines, first, F.size(lines)), "\n")


def dosing_core(text: Column) -> Column:
    """The text up to the sub-heading of a special group: the first one before which a dose stands (and the table, if there is one).

    If no dose is to be seen, a table that is kept is enough; without a table, a paragraph of 250 characters. Where no
    cut will do, the text stays whole.
    """
    lines = F.split(text, "\n")

    def chosen(lines: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(lines, i - 1).rlike(_opens(DOSING_ENDS)))
        cuts = F.transform(at, lambda i: _strip(F.array_join(F.slice(lines, F.lit(1), i - 1), "\n")))
        first = lambda cuts, ok: F.get(F.filter(cuts, ok), F.lit(0))

        def pick(cuts: Column) -> Column:
            dosed = F.when(has_table(text), first(cuts, lambda c: has_table(c) & c.rlike(DOSE))).otherwise(first(cuts, lambda c: c.rlike(DOSE)))
            rest = F.when(has_table(text), first(cuts, has_table)).otherwise(first(cuts, lambda c: F.length(c) >= LEAST_CORE))
            return F.coalesce(dosed, rest, _strip(text))

        return _once(cuts, pick)

    return _once(lines, chosen)


def adverse_core(text: Column) -> Column:
    """The table or list of effects: from the first line with structure to the first closing sub-heading, without the request to report.

    Structure is a table row, a heading or a line of a frequency; such a line takes along the heading of its organ system,
    the short line before it without a stop at its end. Without structure all before the closing sub-heading stays.
    """
    kinds = lambda lines: F.transform(
        lines,
        lambda x: F.when(x.rlike(_opens(ADVERSE_ENDS)), "close").when(F.trim(x).rlike(r"^[|#]"), "mark").when(_strip(x).rlike(FREQUENCY_LINE), "frequency").when(_strip(x) == "", "blank").otherwise("text"),
    )

    def cut(x: Column) -> Column:
        close = F.array_position(x["kinds"], "close")
        n = F.when(close > 0, close - 1).otherwise(F.size(x["lines"])).cast("int")
        lines, kind = F.slice(x["lines"], F.lit(1), n), F.slice(x["kinds"], F.lit(1), n)
        return F.struct(lines.alias("lines"), kind.alias("kinds"))

    def core(x: Column) -> Column:
        marks = F.filter(F.array(F.array_position(x["kinds"], "mark"), F.array_position(x["kinds"], "frequency")), lambda i: i > 0)
        first = F.array_min(marks).cast("int")
        above = F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(first - 1, F.lit(0))), lambda i: (i > 0) & (F.get(x["kinds"], i - 1) != "blank")))
        heading = _strip(F.get(x["lines"], above - 1))
        takes = (F.get(x["kinds"], first - 1) == "frequency") & (above > 0) & (F.length(heading) <= LONGEST_HEADING) & ~heading.endswith(".") & (F.get(x["kinds"], above - 1) != "frequency")
        return _from(x["lines"], F.when(F.coalesce(takes, F.lit(False)), above).otherwise(F.coalesce(first, F.lit(1))))

    lines = F.split(text, "\n")
    whole = _once(lines, lambda y: F.struct(y.alias("lines"), kinds(y).alias("kinds")))
    return _strip(F.regexp_replace(_once(_once(whole, cut), core), rf"(?imu)^[ \t]*#{{0,6}}[ \t]*{REPORTING}.*", ""))


def marked_groups(text: Column) -> Column:
    """Each line under a patient group's heading begins with ``[group]``; other headings end the group.

    A line below such a heading that is itself a group (with age or weight) takes the heading's place for the lines after it. One fold over the
    lines carries the group.
    """
    named = lambda x: x.rlike(rf"(?iu)^\s*#{{1,6}}\s*.*({GROUP_WORDS})")
    title = lambda x: _strip(F.regexp_replace(_strip(F.regexp_replace(x, r"^\s*#{1,6}\s*", "")), r"\s*:$", ""))
    bare = lambda x: F.regexp_replace(_strip(x), r"^[-* ]+", "")
    kind = "struct<group:string,lines:array<string>>"

    def step(state: Column, x: Column) -> Column:
        under = state["group"].isNotNull() & (_strip(x) != "")
        refines = under & bare(x).rlike(REFINEMENT)
        group = F.when(named(x), title(x)).when(F.ltrim(x).startswith("#"), F.lit(None)).when(refines, bare(x)).otherwise(state["group"])
        line = F.when(F.ltrim(x).startswith("#") | refines | ~under, x).otherwise(F.concat(F.lit("["), state["group"], F.lit("] "), _strip(x)))
        return F.struct(group.alias("group"), F.concat(state["lines"], F.array(line)).alias("lines")).cast(kind)

    begun = F.struct(F.lit(None).alias("group"), F.array().alias("lines")).cast(kind)
    return F.aggregate(F.split(text, "\n"), begun, step, lambda s: F.array_join(s["lines"], "\n"))


def core(text: Column, section: Column, trim_dosing: bool = False) -> Column:
    """What of a section goes to extraction: the core of dosing (only with ``trim_dosing``) and of adverse effects; indications and contraindications as one item a line with their groups.

    Section names are ``dosing``, ``adverse``, ``indication`` and ``contraindication``; other sections are only stripped. Null texts stay null.
    """
    listed = section.isin("indication", "contraindication")
    out = F.when(section == "adverse", adverse_core(text)).when(listed, marked_groups(list_to_lines(_strip(text))))
    return (out.when(section == "dosing", dosing_core(text)) if trim_dosing else out).otherwise(_strip(text))
