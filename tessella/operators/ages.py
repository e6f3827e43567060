"""Minimum ages from evidence and bans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import fold

# fixed values: wording over folded text
BAN = r"nestanoven|nebyl[aoy]?\s+stanoven|nedoporuc|nelze\s+doporucit|nema\s+(se|byt)\s+(pouzivat|podavat|uzivat|podavan|pouzivan)|nesmi|kontraindik|nepouziv|neni\s+(urcen|indikovan|doporucen)|nejsou\s+(k\s+dispozici|dostupne)|neexist|nebyl[aoy]?\s+(hodnocen|prokazan|studovan)|bez\s+udaju|pouze\s+(na\s+doporuceni|po\s+porade|pod\s+dohledem)\s+lekare"
DOSE = r"[0-9]|\b(jedn|dve|dva|tri|ctyri|pet|pul|polovin)"
DOCTOR_ONLY = r"(jen|pouze)\s+(na|po|pod|podle)\s+(doporuceni|porade|predpis|dohledem|pokynu)\s+[a-z]*\s*lekar|(jen|pouze)\s+na\s+lekarsky\s+predpis"
FORMS = {
    "injekce": (r"injek|infuz|intraven|i\.\s?v\.|intramusk|i\.\s?m\.|parenter", "INJ|INF|IVN|IMS"), "sprej": (r"sprej|spray|rozprasov|vstrik", "SPR"), "kapky": ("kapk", "GTT"),
    "cipky": ("cipk|rektal|supp", "SUP"), "tablety": ("tablet", "TBL|TAB"), "tobolky": ("tobol|kapsl", "CPS"), "tekute": (r"sirup|suspenz|peroralni\s+roztok|kapalin", "SIR|SUS|POR SOL|SOL POR"),
    "granule": ("granul|prasek|sacek|sack", "GRA|PLV|POR PLV"), "kozni": (r"krem|mast|gel\b|na\s+kuzi", "CRM|UNG|GEL|DRM"),
}
CONDITIONS = {
    "ledviny": r"ledvin|renal|clearance|crcl|gfr|dialyz", "jatra": r"jater|hepat|child", "dialyza": "dialyz", "hmotnost": r"\bkg\b|hmotnost",
    "interakce": r"cyp|inhibitor|induktor|soucasne|v kombinaci|soubezn", "tehotenstvi": r"tehotn|kojici",
}
CHILD_NAME = r"\b(pro deti|junior|baby|detsk|pro kojence|kids|paed|paediatric|pediatric)"


def dose_kind(dose: Column, note: Column) -> Column:
    """yes (a concrete dose), no (a ban) or null (can't be told)."""
    d, n = fold(dose), fold(note)
    return F.when(d.rlike(BAN), "no").when(n.rlike(DOCTOR_ONLY), "no").when(d.rlike(DOSE), "yes").when(n.rlike(BAN), "no")


def other_form(text: Column, form: Column) -> Column:
    """The text names dosage forms, the product has known ones, and none is the same."""
    t = fold(text)
    named = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, (p, _) in FORMS.items()]))
    own = F.array_compact(F.array(*[F.when(form.rlike(rf"(?i)\b({c})"), F.lit(k)) for k, (_, c) in FORMS.items()]))
    return F.coalesce((F.size(named) > 0) & (F.size(own) > 0) & ~F.arrays_overlap(named, own), F.lit(False))


def conditions(text: Column) -> Column:
    t = fold(text)
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in CONDITIONS.items()]))


def raise_age(age: Column, bans: Column) -> Column:
    """Raise an age while a ban [lo, hi) covers it. ``bans`` is an array of structs (lo, hi); open upper bounds are left out.

    One pass in order of (lo, hi) reaches the fix-point: a ban passed over because the age is below it stays above
    nothing that comes later, and one that ends at or below the age can never apply again.
    """
    closed = F.array_sort(F.filter(bans, lambda b: b["hi"].isNotNull()))
    return F.aggregate(closed, age.cast("double"), lambda a, b: F.when((b["lo"] <= a) & (a < b["hi"]), b["hi"].cast("double")).otherwise(a))


def minimum_age(evidence: DataFrame, key: str) -> DataFrame:
    """(key, age_from, for_children): rows (key, kind yes/no, lo, hi, definite_lo) of one document give its minimum age.

    The lowest definite age of the positive evidence is raised by the bans. Null means unknown, never no.
    """
    yes, no = F.col("kind") == "yes", F.col("kind") == "no"
    g = evidence.groupBy(key).agg(
        F.min(F.when(yes, F.col("definite_lo"))).alias("low"),
        F.collect_list(F.when(no, F.struct("lo", "hi"))).alias("bans"),  # the bans of one document
        F.bool_or(yes & (F.col("lo") < 18)).alias("child_yes"),
        F.bool_or(no & (F.col("lo") <= 0) & (F.col("hi").isNull() | (F.col("hi") >= 18))).alias("child_ban"),
    )
    age = F.when(F.col("low").isNotNull(), raise_age(F.col("low"), F.col("bans")))
    child_yes, child_ban = F.coalesce("child_yes", F.lit(False)), F.coalesce("child_ban", F.lit(False))
    unknown = F.when(child_ban, F.lit(False)).when(child_yes, F.lit(True))
    return g.select(key, F.round(age, 2).alias("age_from"), F.when(age.isNull(), unknown).otherwise((age < 18) | (child_yes & ~child_ban)).alias("for_children"))


def age_reasons(evidence: DataFrame, key: str) -> DataFrame:
    """(key, reasons): the audit list of a minimum age, a line for each piece of evidence in its order.

    ``evidence`` has (key, position, part, kind yes/no/null, lo, hi, definite_lo, patient, other_form); ``part`` is the section's number. Evidence of
    another form is named but doesn't count; evidence that is neither yes nor no has no line. Documents without a line say so.
    """
    n = lambda c: F.regexp_replace(F.round(c, 4).cast("double").cast("string"), r"[.]0$", "")
    who = F.substring(F.coalesce("patient", F.lit("")), 1, 60)
    span = F.concat(n(F.col("lo")), F.coalesce(F.concat(F.lit("-"), n(F.col("hi"))), F.lit(" and over")))
    line = (
        F.when(F.coalesce("other_form", F.lit(False)), F.concat("part", F.lit(" other form, not counted: "), who))
        .when(F.col("kind") == "no", F.concat("part", F.lit(" no "), span, F.lit(": "), who))
        .when((F.col("kind") == "yes") & F.col("definite_lo").isNotNull(), F.concat("part", F.lit(" yes from "), n(F.col("definite_lo")), F.lit(": "), who))
        .when(F.col("kind") == "yes", F.concat("part", F.lit(" yes, no age: "), who))
    )
    g = evidence.select(key, F.struct("part", "position", line.alias("line")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("x.line").isNotNull(), F.col("x")))).alias("x"))
    lines = F.transform("x", lambda x: x["line"])
    return g.select(key, F.when(F.size("x") > 0, lines).otherwise(F.array(F.lit("no age in the text"))).alias("reasons"))


def child_only(names: DataFrame, doses: DataFrame, key: str) -> DataFrame:
    """(key, child_only, reason): products for children only, by their name, or by doses for children and none for others.

    ``names`` has (key, name), ``doses`` (key, position, kind, lo, hi, patient), doses of another form left out. A dose without an
    age, or one that reaches adulthood, is for adults too; a group that starts below twelve is children's.
    """
    given = doses.where("kind = 'yes'")
    grown = F.col("lo").isNull() | F.col("hi").isNull() | (F.col("hi") > 18)
    child = F.when(F.col("lo") < 12, F.struct("position", "patient"))
    g = given.groupBy(key).agg(F.bool_or(grown).alias("adult"), F.min(child).alias("child"))
    by_name = F.coalesce(fold(F.col("name")).rlike(CHILD_NAME), F.lit(False))
    by_dose = F.coalesce(~F.col("adult"), F.lit(False)) & F.col("child").isNotNull()
    reason = F.when(by_name, F.concat(F.lit("name: "), F.substring("name", 1, 40))).when(by_dose, F.concat(F.lit("doses for children only: "), F.substring("child.patient", 1, 60))).otherwise("")
    return names.join(g, key, "left").select(key, (by_name | by_dose).alias("child_only"), reason.alias("reason"))
