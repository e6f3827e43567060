"""Structured search filters: one conjunctive condition under three-valued logic."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import fold, strength


def contains_text(c: Column, part: str) -> Column:
    """Case-insensitive substring; no character of ``part`` is a wildcard."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def for_children(children: Column, age_from: Column) -> Column:
    return children.eqNullSafe(True) & (age_from.isNull() | (age_from < 18))


def for_adults(children_only: Column, age_from: Column, children: Column, adult_from: float = 12.0) -> Column:
    return ~children_only.eqNullSafe(True) & ((age_from >= adult_from) | (age_from.isNull() & ~children.eqNullSafe(True)))


def representative(c: Column) -> Column:
    return F.coalesce(c, F.lit(True))


def name_matches(name: Column, kind: str, text: str, codes: list | None = None, code: Column | None = None) -> Column:
    """Name pattern: starts, contains, ends (the end of a word in the name) or about (codes found by similarity)."""
    plain, wanted = fold(name), fold(F.lit(text))
    if kind == "starts":
        return F.startswith(plain, wanted)
    if kind == "contains":
        return F.contains(plain, wanted)
    if kind == "ends":
        return plain.rlike("".join(ch for ch in text.lower() if ch.isalnum()) + r"([^a-z0-9]|$)")
    if kind == "about":
        return code.isin(codes or [])
    raise ValueError(f"unknown name pattern {kind}")


@dataclass(frozen=True)
class SearchFilter:
    """Optional predicates; all that are set must hold. Filters apply before any ranking."""

    sections: tuple[str, ...] = ()
    rx: bool | None = None
    reimbursed: bool | None = None
    strength: str | None = None
    atc_prefix: str | None = None
    organ: str | None = None
    frequency: str | None = None
    max_rank: int | None = None
    children: bool = False
    age: float | None = None
    adults: bool = False
    name_kind: str | None = None
    name_text: str | None = None
    group_code: str | None = None
    name_part: str | None = None
    code: str | None = None
    substance: str | None = None

    @property
    def exact(self) -> bool:
        """Whether a filter picks rows by identity; the threshold is then switched off."""
        return any((self.name_kind, self.name_part, self.code, self.substance, self.strength, self.atc_prefix, self.frequency, self.max_rank))

    def condition(self) -> Column:
        """The conjunction over columns section, rx, reimbursed, strength, atc, organ, frequency, freq_rank, for_children,
        children_only, age_from, name, attrs (JSON), code and substances (array)."""
        c, out = F.col, F.lit(True)
        if self.sections:
            out &= c("section").isin(*self.sections)
        if self.rx is not None:
            out &= c("rx") == self.rx
        if self.reimbursed is not None:
            out &= c("reimbursed") == self.reimbursed
        if self.strength:
            out &= strength("strength") == self.strength.replace(" ", "").upper()
        if self.atc_prefix:
            out &= c("atc").startswith(self.atc_prefix)
        if self.organ:
            out &= c("organ") == self.organ
        if self.frequency:
            out &= c("frequency") == self.frequency
        elif self.max_rank is not None:
            out &= c("freq_rank") <= self.max_rank
        if self.children:
            out &= for_children(c("for_children"), c("age_from"))
        if self.age is not None:
            out &= c("age_from") <= self.age
        if self.adults:
            out &= for_adults(c("children_only"), c("age_from"), c("for_children"))
        if self.name_kind:
            out &= name_matches(c("name"), self.name_kind, self.name_text or "")
        if self.group_code:
            out &= F.get_json_object("attrs", "$.group_code") == self.group_code
        if self.name_part:
            out &= contains_text(c("name"), self.name_part)
        if self.code:
            out &= c("code") == self.code
        if self.substance:
            out &= F.exists("substances", lambda s: contains_text(s, self.substance))
        return out

    def describe(self) -> str:
        """The filter in words, for the reader of an empty result."""
        parts = [f"{f.name.replace('_', ' ')} = {getattr(self, f.name)}" for f in fields(self) if getattr(self, f.name) not in (None, (), False)]
        return "; ".join(parts) or "no filter"
