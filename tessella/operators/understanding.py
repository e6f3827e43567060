"""Deterministic reading of questions and of patient groups: ages, name patterns, expansion by a dictionary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import fold, phonetic, tokens
from tessella.operators.similarity import occurrences

ADULT = 18.0
# fixed values: patterns over folded text (lower case, no accents)
NUMBER = r"([0-9]+(?:[,.][0-9]+)?)"
UNIT = r"(let|roku|roky|rok|mesic[a-z]*|mes\.?|tydn[a-z]*|tyden)"
RANGE = rf"(?:od\s+)?{NUMBER}\s*(?:–|-|az|do)\s*{NUMBER}\s*{UNIT}"
FROM_BEFORE = rf"(?:od|nad|≥|>=|starsi\s+(?:nez\s+)?|ve\s+veku)\s*{NUMBER}\s*{UNIT}"
FROM_AFTER = rf"{NUMBER}\s*{UNIT}\s*(?:a\s+starsi|a\s+vice|a\s+vyse|a\s+starsich)"
UP_TO = rf"(?:do|pod|<|mladsi\s+nez|mladsich\s+nez|mladsich|mladsi|mene\s+nez)\s*{NUMBER}\s*{UNIT}"
GROUPS = [
    (r"novoroz", 0.0, 0.1), (r"kojen(c|cu|ce|cum|ci)", 0.0, 1.0), (r"batol", 1.0, 3.0), (r"pediatr|det|dite", 0.0, ADULT),
    (r"dospivaj", 12.0, ADULT), (r"star(si|sich)\s+(pacient|osob|lid|dospel)|senio|geriatr", 65.0, None), (r"dospel", ADULT, None),
]
ANY_CHILD = r"pediatr|det|dite"
CHILD = r"\b((?:u|pro)\s+(?:dite[a-z]*|det[a-z]*)|detem|dite[a-z]*|deti|detsk[a-z]*|pediatr[a-z]*|skolak[a-z]*|predskolak[a-z]*)\b"
INFANT = r"\b(kojenc[a-z]*|kojenec|kojenk[a-z]*|miminek|miminko|miminka|novoroz[a-z]*)\b"
TODDLER = r"\bbatol[a-z]*"
AGE_DIGITS = r"([0-9]+)\s*[- ]?\s*(let[yaeiou][a-z]*|let|roky|roku|rok[a-z]*|mesicn[a-z]*|mesic[a-z]*)"
STEMS = {
    "jedno": 1, "dvou": 2, "tri": 3, "ctyr": 4, "peti": 5, "sesti": 6, "sedmi": 7, "osmi": 8, "deviti": 9, "deseti": 10, "jedenacti": 11,
    "dvanacti": 12, "trinacti": 13, "ctrnacti": 14, "patnacti": 15, "sestnacti": 16, "sedmnacti": 17,
}
CARDINALS = {
    "jeden": 1, "jedna": 1, "jedno": 1, "dva": 2, "dve": 2, "tri": 3, "ctyri": 4, "pet": 5, "sest": 6, "sedm": 7, "osm": 8, "devet": 9,
    "deset": 10, "jedenact": 11, "dvanact": 12, "trinact": 13, "ctrnact": 14, "patnact": 15, "sestnact": 16, "sedmnact": 17,
}
AGE_STEM = rf"\b({'|'.join(STEMS)})(let[yaeiou][a-z]*|mesicn[a-z]*)"
AGE_CARDINAL = rf"\b({'|'.join(sorted(CARDINALS, key=len, reverse=True))})\s+(let|roky|roku|rok[a-z]*|mesic[a-z]*|tydn[a-z]*|tyden)\b"
HALF_YEAR = r"\bpul\s*roku\b|\bpulrocni[a-z]*"
ADULTS = r"\b(?:(?:pro|u)\s+)?dospel[a-z]*"
NAME_PATTERN = r"\b(?:leky|leku|lek|lecivo|pripravek)\s+(zacina|zacinajici|obsahuje|obsahujici|konci|koncici|priblizne)\s+(?:na\s+)?([^\s,;.!?]+)"


def _found(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _years(number: Column, unit: Column) -> Column:
    x = F.replace(number, F.lit(","), F.lit(".")).cast("double")
    return F.when(unit.startswith("mes"), x / 12).when(unit.startswith("tyd"), x / 52).otherwise(x)


def age_range(text: Column) -> tuple[Column, Column, Column]:
    """(known, from, to) in years: a range in numbers, else one-sided bounds, else the span of the groups named."""
    t = fold(text)
    span = t.rlike(RANGE)
    before, after = t.rlike(FROM_BEFORE), t.rlike(FROM_AFTER)
    low = F.when(before, _years(_found(t, FROM_BEFORE, 1), _found(t, FROM_BEFORE, 2))).when(after, _years(_found(t, FROM_AFTER, 1), _found(t, FROM_AFTER, 2)))
    high = F.when(t.rlike(UP_TO), _years(_found(t, UP_TO, 1), _found(t, UP_TO, 2)))
    sided = before | after | t.rlike(UP_TO)
    lows = F.array_min(F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(lo)) for p, lo, _ in GROUPS])))
    open_ = F.lit(False)
    for p, _, hi in GROUPS:
        if hi is None:
            open_ = open_ | t.rlike(p)
    highs = F.array_max(F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(hi)) for p, _, hi in GROUPS if hi is not None])))
    unit = _found(t, RANGE, 3)
    lo = F.when(span, _years(_found(t, RANGE, 1), unit)).when(sided, F.coalesce(low, F.lit(0.0))).otherwise(lows)
    hi = F.when(span, _years(_found(t, RANGE, 2), unit)).when(sided, high).when(~open_, highs)
    return lo.isNotNull(), lo, hi


def age_in_numbers(text: Column) -> Column:
    t = fold(text)
    return t.rlike(RANGE) | t.rlike(FROM_BEFORE) | t.rlike(FROM_AFTER) | t.rlike(UP_TO)


def definite_age_from(text: Column) -> Column:
    """Lower bound from a number or a word with a clear limit; "children" alone or an upper bound alone gives null."""
    t = fold(text)
    lower = t.rlike(RANGE) | t.rlike(FROM_BEFORE) | t.rlike(FROM_AFTER)
    _, lo, _ = age_range(text)
    _, rest, _ = age_range(F.regexp_replace(t, ANY_CHILD, " "))
    return F.when(age_in_numbers(text), F.when(lower, lo)).otherwise(rest)


def _numeral(word: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), word).cast("double")


def age_in_query(question: Column) -> tuple[Column, Column]:
    """(for_children, age) of a lay question: digits, compound words, cardinal words, half a year, infants and toddlers."""
    t = fold(question)

    def scaled(n: Column, unit: Column) -> Column:
        return F.when(unit.startswith("mes"), n / 12).when(unit.startswith("tyd"), n / 52).otherwise(n)

    age = (
        F.when(t.rlike(AGE_DIGITS), scaled(_found(t, AGE_DIGITS, 1).cast("double"), _found(t, AGE_DIGITS, 2)))
        .when(t.rlike(AGE_STEM), scaled(_numeral(_found(t, AGE_STEM, 1), STEMS), _found(t, AGE_STEM, 2)))
        .when(t.rlike(AGE_CARDINAL), scaled(_numeral(_found(t, AGE_CARDINAL, 1), CARDINALS), _found(t, AGE_CARDINAL, 2)))
        .when(t.rlike(HALF_YEAR), F.lit(0.5))
        .when(t.rlike(INFANT), F.lit(0.5))
        .when(t.rlike(TODDLER), F.lit(2.0))
    )
    child = t.rlike(CHILD) | t.rlike(INFANT) | t.rlike(TODDLER)
    none = F.coalesce((age >= ADULT) | ~(child | t.rlike(AGE_STEM)), F.lit(False)) & age.isNotNull()
    return F.when(~none & (child | age.isNotNull()), F.lit(True)), F.when(~none, age)


def adults_in_query(question: Column) -> Column:
    """Asked for adults, and no child is mentioned."""
    return fold(question).rlike(ADULTS) & age_in_query(question)[0].isNull()


def without_age(question: Column) -> Column:
    """The folded question without words about age, for the vector."""
    t = fold(question)
    for p in (AGE_DIGITS, AGE_STEM, AGE_CARDINAL, HALF_YEAR, CHILD, INFANT, TODDLER, ADULTS):
        t = F.regexp_replace(t, p, " ")
    t = F.regexp_replace(F.trim(t), r"\b(pro|u|pro\s+moje|pro\s+nase|meho|naseho|male[a-z]*)\s*$", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def name_pattern(question: Column) -> tuple[Column, Column, Column]:
    """(kind, text, valid): starts, contains, ends or about; valid from three characters on."""
    t = fold(question)
    word = _found(t, NAME_PATTERN, 1)
    kind = F.when(word.startswith("zac"), "starts").when(word.startswith("obs"), "contains").when(word.startswith("kon"), "ends").when(word.startswith("pri"), "about")
    text = F.regexp_replace(_found(t, NAME_PATTERN, 2), r"^[„“\"'*…]+|[„“\"'*…]+$", "")
    return kind, text, F.length(text) >= 3


def dictionary_trie(dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The expressions (expr) as a trie over words: edges (node, prefix, child) and ends (node, expr). The root is the empty string.

    A node is named by the words that lead to it, one space between them. Expressions without words are left out.
    """
    keys = dictionary.select("expr", tokens("expr").alias("k")).where(F.size("k") > 0).distinct()
    path = lambda i: F.array_join(F.slice("k", F.lit(1), i), " ")
    steps = F.transform(F.sequence(F.lit(1), F.size("k")), lambda i: F.struct(path(i - 1).alias("node"), F.get("k", i - 1).alias("prefix"), path(i).alias("child")))
    return keys.select(F.explode(steps).alias("x")).select("x.*").distinct(), keys.select(F.array_join("k", " ").alias("node"), "expr")


def trie_matches(questions: DataFrame, id_col: str, text_col: str, dictionary: DataFrame) -> DataFrame:
    """Rows (id, expr): expressions whose words are prefixes of consecutive words of the question.

    The trie is walked a level at a time: where a walk stands, the prefixes of the next word meet the edges by
    equality, from every word of a question at once. There are as many levels as the longest expression has words.
    """
    edges, ends = dictionary_trie(dictionary)
    size = edges.agg(F.max(F.size(F.split("child", " "))).alias("levels"), F.max(F.length("prefix")).alias("longest")).first()
    words = questions.select(F.col(id_col).alias("id"), F.posexplode(tokens(text_col)).alias("pos", "word"))
    begun = F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(size.longest or 1))), lambda n: F.left("word", n))
    prefixes = words.select("id", "pos", F.explode(begun).alias("prefix"))
    at = None
    found = []
    for _ in range(size.levels or 0):
        standing = prefixes.withColumn("node", F.lit("")) if at is None else at.join(prefixes, ["id", "pos"])
        at = standing.join(edges, ["node", "prefix"]).select("id", (F.col("pos") + 1).alias("pos"), F.col("child").alias("node")).distinct()
        found.append(at.select("id", "node"))
    if not found:
        return words.select("id", F.lit("").alias("expr")).limit(0)
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return nodes.join(ends, "node").select("id", "expr").distinct()


def expand(questions: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, limit: int = 4) -> DataFrame:
    """(id, variants): the question first, then wordings whose key's words are prefixes of consecutive words of it.

    ``dictionary`` has (expr, wording, pos); of any size, as questions meet it through ``trie_matches``. Longer keys come
    first, equal lengths by key. ``id_col`` tells questions apart; a null text has itself as its only variant.
    """
    hits = trie_matches(questions, id_col, text_col, dictionary).join(dictionary.select("expr", "wording", "pos"), "expr")
    found = hits.groupBy(F.col("id").alias(id_col)).agg(F.array_sort(F.collect_list(F.struct((-F.length("expr")).alias("l"), "expr", "pos", "wording"))).alias("f"))
    more = F.coalesce(F.transform("f", lambda x: x["wording"]), F.array().cast("array<string>"))
    variants = F.array_distinct(F.concat(F.array(text_col), more))
    return questions.select(id_col, text_col).join(found, id_col, "left").select(id_col, F.slice(variants, 1, limit + 1).alias("variants"))


def safety_net(questions: DataFrame, id_col: str, text_col: str, found: DataFrame, terms: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, prefix, n) for questions that found nothing: the classes whose terms occur in them, and how many rows those have.

    ``found`` (id) are the questions with results, which get none; ``terms`` has (term, prefix), ``classes`` a row (prefix) for each row that
    the search's own filters let through. Terms meet the distinct questions by ``similarity.occurrences``.
    """
    empty = questions.select(id_col, F.col(text_col).alias("whole")).join(found.select(id_col).distinct(), id_col, "left_anti")
    met = occurrences(terms, "term", empty, "whole").withColumnRenamed("part", "term")
    sizes = classes.groupBy("prefix").agg(F.count("*").alias("n"))
    return empty.join(met, "whole").join(terms, "term").select(id_col, "prefix").distinct().join(sizes, "prefix").select(id_col, "prefix", "n")


def name_fragments(names: DataFrame, id_col: str, name_col: str, least: int = 3) -> DataFrame:
    """(fragment, id): sound-alike words of a name, joined neighbours, and the whole name in one piece."""
    words = F.regexp_extract_all(phonetic(name_col), F.lit("[a-z0-9]+"), F.lit(0))
    w = names.select(F.col(id_col).alias("id"), words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat(F.get("w", i - 1), F.coalesce(F.get("w", i), F.lit(""))))
    all_ = F.array_distinct(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")), F.array(F.array_join("w", ""))))
    return w.select("id", F.explode(all_).alias("fragment")).where(F.length("fragment") >= least)


def length_band(a: Column, b: Column) -> Column:
    """Lengths close enough for the words to be similar at all."""
    return F.abs(F.length(a) - F.length(b)) <= F.greatest(F.lit(3), F.floor(F.length(b) / 2))


def restore_accents(text: Column, question: Column) -> Column:
    """Words of ``text`` written as the user wrote them, where only accents or case differ."""
    own = F.split(question, r"\s+")
    same = lambda w: F.get(F.filter(own, lambda q: fold(F.regexp_replace(q, r"[.,;:!?]+$", "")) == fold(w)), F.lit(0))
    return F.array_join(F.transform(F.split(text, r"\s+"), lambda w: F.coalesce(F.regexp_replace(same(w), r"[.,;:!?]+$", ""), w)), " ")


@dataclass
class Route:
    """What a router found in a question."""

    sections: list[str] = field(default_factory=list)
    children: bool | None = None
    age: float | None = None
    adults: bool = False
    name: tuple[str, str] | None = None
    residual: str = ""
    confidence: str = "low"


class RuleRouter:
    """A deterministic router: keyword rules pick sections; age and name rules always apply. Models can take its place."""

    def __init__(self, keywords: dict[str, list[str]], all_sections: list[str]):
        self.keywords, self.all_sections = keywords, all_sections

    def columns(self, question: Column) -> dict[str, Column]:
        """The route as columns: sections, for_children, age, adults, name_kind, name_text, residual, confidence."""
        t = fold(question)
        named = F.array_compact(F.array(*[F.when(t.rlike(rf"\b({'|'.join(words)})"), F.lit(s)) for s, words in self.keywords.items()]))
        children, age = age_in_query(question)
        kind, text, valid = name_pattern(question)
        unsure = F.size(named) == 0
        return {
            "sections": F.when(unsure, F.array(*[F.lit(s) for s in self.all_sections])).otherwise(named),
            "for_children": children,
            "age": age,
            "adults": adults_in_query(question),
            "name_kind": F.when(valid, kind),
            "name_text": F.when(valid, text),
            "residual": F.trim(F.regexp_replace(F.regexp_replace(without_age(question), NAME_PATTERN, " "), r"\s+", " ")),
            "confidence": F.when(unsure, "low").otherwise("high"),
        }
