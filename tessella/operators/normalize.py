"""Controlled vocabularies: frequencies, patient groups, organ systems, answers of extractors, support in the source."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.python import closest_of
from tessella.functions.text import ACCENTED, PLAIN, fold, squash, squeeze, strip_fence

# fixed values: the frequency scale, its ranks and other wordings
RANKS = {"velmi caste": 1, "caste": 2, "mene caste": 3, "vzacne": 4, "velmi vzacne": 5, "neni znamo": 9}
CANON = {1: "velmi časté", 2: "časté", 3: "méně časté", 4: "vzácné", 5: "velmi vzácné", 9: "není známo"}
SYNONYMS = {
    "neznama frekvence": "neni znamo", "frekvence neznama": "neni znamo", "neni znama": "neni znamo", "ojedinele": "neni znamo",
    "vyjimecne": "neni znamo", "zridka": "neni znamo", "v ojedinelych pripadech": "neni znamo",
}
UNKNOWN_RANK = 9
# fixed values: patient groups by the first part found
GROUP_PARTS = [("kojen", "kojenci"), ("novorozen", "kojenci"), ("det", "deti"), ("dit", "deti"), ("dospivaj", "dospivajici"), ("dospel", "dospeli"), ("starsi", "starsi"), ("senior", "starsi")]
# fixed values: organ-system classes
ORGANS = [
    "Infekce a infestace", "Novotvary benigní, maligní a blíže neurčené", "Poruchy krve a lymfatického systému", "Poruchy imunitního systému",
    "Endokrinní poruchy", "Poruchy metabolismu a výživy", "Psychiatrické poruchy", "Poruchy nervového systému", "Poruchy oka",
    "Poruchy ucha a labyrintu", "Srdeční poruchy", "Cévní poruchy", "Respirační, hrudní a mediastinální poruchy", "Gastrointestinální poruchy",
    "Poruchy jater a žlučových cest", "Poruchy kůže a podkožní tkáně", "Poruchy svalové a kosterní soustavy a pojivové tkáně",
    "Poruchy ledvin a močových cest", "Stavy spojené s těhotenstvím, šestinedělím a perinatálním obdobím", "Poruchy reprodukčního systému a prsu",
    "Vrozené, familiární a genetické vady", "Celkové poruchy a reakce v místě aplikace", "Vyšetření",
    "Poranění, otravy a procedurální komplikace", "Chirurgické a léčebné postupy", "Sociální okolnosti",
]
# fixed values: words that don't count as support
FILLER = ["pri", "pro", "nebo", "jsou", "ktery", "ktera", "ktere", "lecba", "leceni", "prevence"]


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def frequency_key(value: Column) -> Column:
    """Without notes in parentheses, folded, squeezed, no colon at the end; other wordings mapped."""
    k = F.regexp_replace(squeeze(fold(F.regexp_replace(value, r"\(.*?\)", " "))), ":+$", "")
    return F.coalesce(_lookup(SYNONYMS, k), k)


def frequency(value: Column) -> tuple[Column, Column]:
    """(text, rank); a value outside the scale stays as it is with the unknown rank, nothing gives (null, unknown)."""
    empty = value.isNull() | (value == "")
    rank = F.coalesce(_lookup(RANKS, frequency_key(value)), F.lit(UNKNOWN_RANK))
    known = _lookup(RANKS, frequency_key(value)).isNotNull()
    text = F.when(empty, F.lit(None).cast("string")).when(known, _lookup(CANON, rank)).otherwise(F.trim(value))
    return text, F.when(empty, F.lit(UNKNOWN_RANK)).otherwise(rank)


def near_frequency(value: Column) -> tuple[Column, Column]:
    """As ``frequency``, but a misspelt value takes the nearest wording of the scale (gestalt ratio of 0.75 or more)."""
    text, rank = frequency(value)
    key = frequency_key(value)
    misspelt = (value != "") & _lookup(RANKS, key).isNull()
    near = _lookup(RANKS, closest_of(list(RANKS), 0.75)(F.when(misspelt, key)))
    return F.when(near.isNotNull(), _lookup(CANON, near)).otherwise(text), F.coalesce(near, rank)


def group_code(value: Column) -> Column:
    """The patient group as a code; nothing given is said explicitly."""
    t = fold(value)
    out = F.when(F.trim(F.coalesce(value, F.lit(""))) == "", F.lit("neuvedeno"))
    for part, code in GROUP_PARTS:
        out = out.when(F.contains(t, F.lit(part)), F.lit(code))
    return out.otherwise(F.lit("jine"))


def organ(value: Column) -> tuple[Column, Column]:
    """(canonical name, how): exact after squashing, or the cleaned value as unknown; nothing gives (null, empty)."""
    clean = F.regexp_replace(F.regexp_replace(value, r"(?i)\s*\((viz|see)[^)]*\)|[*†‡]+", ""), r"^[ .:;,]+|[ .:;,]+$", "")
    table = F.create_map(*[x for o in ORGANS for x in (squash(F.lit(o)), F.lit(o))])
    key = squash(clean)
    hit = F.try_element_at(table, key)
    empty = value.isNull() | (F.coalesce(key, F.lit("")) == "")
    how = F.when(empty, "prazdna").when(hit.isNotNull(), "presna").otherwise("nezname")
    return F.when(empty, F.lit(None).cast("string")).otherwise(F.coalesce(hit, clean)), how


def near_organ(value: Column) -> tuple[Column, Column]:
    """As ``organ``, but an unknown name takes the nearest canonical one (gestalt ratio of 0.85 or more, squashed)."""
    name, how = organ(value)
    squashed = {re.sub("[^a-z0-9]", "", o.lower().translate(str.maketrans(ACCENTED, PLAIN))): o for o in ORGANS}
    near = _lookup(squashed, closest_of(list(squashed), 0.85)(F.when(how == "nezname", squash(name))))
    return F.coalesce(near, name), F.when(near.isNotNull(), "pribuzna").otherwise(how)


def answer_state(raw: Column, keys: list[str]) -> tuple[Column, Column, Column]:
    """(state, items, valid): the state of a JSON answer {"items": [...]}: failed, empty, partial or unverified."""
    parsed = F.from_json(strip_fence(raw), "items array<map<string,string>>")
    items = parsed["items"]
    good = F.filter(items, lambda m: F.forall(F.array(*[F.lit(k) for k in keys]), lambda k: F.length(F.coalesce(F.try_element_at(m, k), F.lit(""))) > 0))
    n, ok = F.coalesce(F.size(items), F.lit(-1)), F.coalesce(F.size(good), F.lit(0))
    n = F.when(items.isNull(), -1).otherwise(n)
    state = F.when(n < 0, "selhala_extrakce").when(n == 0, "prazdna").when(ok == 0, "selhala_extrakce").when(ok < n, "castecna").otherwise("neovereno")
    return state, F.greatest(n, F.lit(0)), F.when(items.isNull(), 0).otherwise(ok)


def significant(text: Column) -> Column:
    """Distinct words of three letters and more, folded, without filler."""
    words = F.regexp_extract_all(fold(text), F.lit("[a-z]+"), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), F.array(*[F.lit(w) for w in FILLER]))


def word_starts(text: Column) -> Column:
    """What support is looked up in: the significant words of a source and their first four letters, as one array."""
    return F.transform(F.array(significant(text)), lambda s: F.array_distinct(F.concat(s, F.transform(s, lambda z: F.concat(F.lit("^"), F.substring(z, 1, 4))))))[0]


def supported(words: Column, starts: Column, least: float = 0.5) -> Column:
    """At least half of a key's significant words are in a source's ``word_starts``: by their first four letters, three-letter words as they are."""
    wanted = F.transform(words, lambda w: F.when(F.length(w) >= 4, F.concat(F.lit("^"), F.substring(w, 1, 4))).otherwise(w))
    # the source is gone through once, by hash; words of one beginning count each
    hits = F.get(F.transform(F.array(F.array_intersect(wanted, starts)), lambda met: F.size(F.filter(wanted, lambda w: F.array_contains(met, w)))), F.lit(0))
    return F.coalesce((F.size(words) > 0) & (hits >= least * F.size(words)), F.lit(False))


def has_support(key: Column, source: Column, least: float = 0.5) -> Column:
    """``supported`` of two texts."""
    return supported(significant(key), word_starts(source), least)


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0))


def missing_numbers(value: Column, source: Column) -> Column:
    """Numbers of the value that the source doesn't have, read with and without spaces between thousands."""
    glued = F.regexp_replace(source, r"([0-9]) ([0-9]{3})\b", "$1$2")
    return F.array_except(numbers(value), F.concat(numbers(source), numbers(glued)))


#: fixed values: scripts that no Czech text has (Greek letters are used in names of substances)
FOREIGN_SCRIPT = "[\u0400-\u04ff\u4e00-\u9fff]"


def foreign_script(value: Column) -> Column:
    """Whether a value has letters of a script that it can't have: Cyrillic, or Chinese characters."""
    return F.coalesce(value.rlike(FOREIGN_SCRIPT), F.lit(False))
