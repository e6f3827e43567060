"""Lemmas against a plain affix expander, covers against brute force, and what the index reads."""

import random
import re

import pytest

from tessella.operators import fulltext, lemmas

AFF = """SET UTF-8
# suffixes and prefixes of a small language
PFX U Y 2
PFX U 0 un .
PFX U 0 im [pm]
SFX S Y 3
SFX S 0 s [^sy]
SFX S y ies [^aeiou]y
SFX S 0 es s
SFX D Y 2
SFX D e ed e
SFX D 0 ed [^e]  # note
SFX N N 1
SFX N y iness y
"""
DIC = """9
happy/UNS
bake/UD
like/UDS
pass/SD
possible/U
berry/S
žába/S
the
of
"""
STOP = "the\nof\nlike\n"


@pytest.fixture(scope="module")
def dictionaries(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("dictionary")
    for name, text in (("a.aff", AFF), ("a.dic", DIC), ("a.stop", STOP)):
        (d / name).write_text(text)
    style = lemmas.flag_style(spark, str(d / "a.aff"))
    assert style == "char"
    return fulltext.Dictionaries(lemmas.read_affixes(spark, str(d / "a.aff")), lemmas.read_stems(spark, str(d / "a.dic"), style), lemmas.read_stop(spark, str(d / "a.stop")))


def plain_forms():
    """form -> its stems: every stem with every affix that its flags and the conditions allow."""
    rules, cross = [], {}
    for line in AFF.splitlines():
        p = line.split("#")[0].split()
        if p and p[0] in ("PFX", "SFX"):
            if p[2] in "YN" and p[3].isdigit():
                cross[p[1]] = p[2] == "Y"
            else:
                rules.append((p[0], p[1], "" if p[2] == "0" else p[2], p[3], p[4]))
    forms = {}

    def put(kind, stem, strip, add, cond):
        if kind == "SFX":
            return stem[: len(stem) - len(strip)] + add if stem.endswith(strip) and re.search(f"(?:{cond})$", stem) else None
        return add + stem[len(strip) :] if stem.startswith(strip) and re.match(cond, stem) else None

    for line in DIC.splitlines()[1:]:
        stem, _, flags = line.partition("/")
        forms.setdefault(stem, set()).add(stem)
        own = [r for r in rules if r[1] in flags]
        for r in own:
            if (form := put(r[0], stem, *r[2:])) is not None:
                forms.setdefault(form, set()).add(stem)
        for pre in (r for r in own if r[0] == "PFX" and cross[r[1]]):
            for suf in (r for r in own if r[0] == "SFX" and cross[r[1]]):
                if (form := put("PFX", stem, *pre[2:])) and (form := put("SFX", form, *suf[2:])):
                    forms.setdefault(form, set()).add(stem)
    return forms


def test_lemmas_equal_plain_expansion(spark, dictionaries):
    forms = plain_forms()
    assert {"unhappies", "impossible", "passes", "berries", "happiness", "unbaked", "žábas"} <= set(forms) and "unhappiness" not in forms
    others = ["bakeed", "happys", "unberries", "ed", "s", "unpossible", "xyz", "likeds"]
    words = spark.createDataFrame([(w,) for w in [*forms, *others, None, "happy"]], "word string")
    got = {}
    for r in lemmas.lemmas(words, dictionaries.rules, dictionaries.stems).collect():
        got.setdefault(r.word, set()).add(r.lemma)
    assert got == {w: s for w, s in forms.items()} | {w: forms[w] for w in others if w in forms}


def test_flag_styles(spark, tmp_path):
    for style, flags in (("long", "AaB1"), ("num", "12,7")):
        (tmp_path / style).write_text(f"FLAG {style}\n")
        (tmp_path / f"{style}.dic").write_text(f"2\nwalk/{flags}\nWalk/{flags[:2]}\n")
        assert lemmas.flag_style(spark, str(tmp_path / style)) == style
        (r,) = lemmas.read_stems(spark, str(tmp_path / f"{style}.dic"), style).collect()
        assert (r.stem, sorted(r.flags)) == ("walk", sorted({"long": ["Aa", "B1"], "num": ["12", "7"]}[style]))


def test_first_dictionary_that_knows_a_word_wins(spark, dictionaries):
    rows = [(1, "Berries"), (2, "liked"), (3, "of"), (4, "Ôf"), (5, "žába"), (6, "zába"), (7, None)]
    got = lemmas.lexemes(spark.createDataFrame(rows, "id int, word string"), dictionaries.rules, dictionaries.stems, dictionaries.stop).collect()
    assert sorted(map(tuple, got)) == [(1, "berry"), (5, "žába"), (6, "zaba")]  # liked becomes a stop word, ôf one without its accent


def plain_rank(words, asked):
    """Sum over all minimal stretches, tried one by one."""
    at = [[i for i, w in enumerate(words) if w & set(s)] for s in asked.slots]
    hit = sorted({i for x in at for i in x})
    holds = lambda a, b: any(all(any(a <= i <= b for i in at[s]) for s in c) for c in asked.clauses)
    stretches = [(a, b) for a in hit for b in hit if a <= b and holds(a, b)]
    small = [(a, b) for a, b in stretches if not any((c, d) != (a, b) and a <= c and d <= b for c, d in stretches)]
    return sum(1 / (1 + (b - a) - (sum(a <= i <= b for i in hit) - 1)) for a, b in small)


@pytest.mark.parametrize("seed", range(4))
def test_covers_equal_brute_force(spark, seed):
    r = random.Random(seed)
    slots = (("a",), ("b", "c"), ("d",), ("c", "e"))
    asked = fulltext.TextQuery(slots, tuple(tuple(r.sample(range(4), r.randint(1, 3))) for _ in range(r.randint(1, 3))))
    docs = [[set(r.sample("abcdexyz", r.choice([1, 1, 1, 2]))) for _ in range(r.randint(0, 25))] for _ in range(60)]
    rows = [(t, i, [p for p, w in enumerate(words) if t in w]) for i, words in enumerate(docs) for t in "abcde" if any(t in w for w in words)]
    got = {x.id: x["rank"] for x in fulltext.cover_ranks(spark.createDataFrame(rows, "term string, id long, positions array<int>"), asked).collect()}
    want = {i: plain_rank(words, asked) for i, words in enumerate(docs)}
    assert got == {i: pytest.approx(x) for i, x in want.items() if x}


def test_index_reads_its_terms_only(spark, dictionaries, tmp_path):
    rows = [(1, "Unhappy berries passed by", "berry"), (2, "the possible happiness", None), (3, None, None), (4, "", ""), (5, "Žábas of the berry, berries berry", None)]
    path = str(tmp_path / "index")
    fulltext.write_index(spark.createDataFrame(rows, "doc long, text string, key string"), path, dictionaries, "doc", "text", "key", buckets=8)
    held = {(r.term, r.id): r.positions for r in spark.read.parquet(path).collect()}
    assert held["berry", 1] == [0, 2, 5, 7] and held["possible", 2] == [1, 4] and ("the", 2) not in held and held["žába", 5] == [0] and held["zabas", 5] == [6]
    asked = fulltext.text_query(spark, ["Berries the happy", "berry passes", "of"], dictionaries)
    assert asked == fulltext.TextQuery((("berry",), ("happy",), ("pass",)), ((0,), (1,), (0, 2)))
    ranks = {r.id: r["rank"] for r in fulltext.text_ranks(spark, path, asked, 8).collect()}
    assert set(ranks) == {1, 2, 5} and ranks[2] == 2.0
    plan = fulltext.read_postings(spark, path, asked.terms, 8)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan and re.search(r"PartitionFilters: \[.*bucket", plan)
    assert fulltext.text_ranks(spark, path, fulltext.text_query(spark, ["of the"], dictionaries), 8).count() == 0
