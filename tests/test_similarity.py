"""Similarity joins against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

import __spark_entry__ as entry
from tessella.operators import routing, similarity
from tessella.operators import understanding as U


def words_with_edits(r, n):
    out = set()
    while len(out) < n:
        w = "".join(r.choice("aabcdeř") for _ in range(r.randint(1, 12)))
        out.add(w)
        i = r.randrange(len(w))
        out |= {w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :], w[:i] + r.choice("abxy") + w[i:], w[:i] + w[i + 1 :] or "a", w * 2}
    return sorted(out)


@pytest.mark.parametrize("least", [0.5, 0.75, 0.8, 0.95])
def test_pairs_equal_all_pairs(spark, least):
    r = random.Random(int(least * 100))
    a, b = words_with_edits(r, 150), words_with_edits(r, 150)
    b = sorted({*b, *r.sample(a, 40)})
    df = lambda x: spark.createDataFrame([(w,) for w in [*x, None, ""]], "w string")
    got = {(x.left, x.right): x.ratio for x in similarity.similar_pairs(df(a), "w", df(b), "w", least).collect()}
    want = {(x, y): q for x in a for y in b if (q := SequenceMatcher(None, x, y).ratio()) >= least}
    assert got == want


def test_pairs_have_no_nested_loop(spark):
    df = spark.createDataFrame([("abc",)], "w string")
    plan = similarity.similar_pairs(df, "w", df, "w", 0.75)._jdf.queryExecution().toString()
    joins = [line for line in plan.splitlines() if "NestedLoop" in line or "CartesianProduct" in line]
    assert all("Cross" in line for line in joins)  # only the one-row table of letters


def test_contained_equal_all_pairs(spark):
    r = random.Random(1)
    wholes = ["".join(r.choice("abc ") for _ in range(r.randint(0, 14))) for _ in range(80)]
    parts = [w[i : i + r.randint(1, 6)] for w in wholes for i in (0, 3)] + ["".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(80)] + [""]
    df = lambda x: spark.createDataFrame([(w,) for w in [*x, None]], "w string")
    got = {x.part for x in similarity.contained_in(df(parts), "w", df(wholes), "w").collect()}
    assert got == {p for p in parts if p and any(p in w for w in wholes)}


def test_names_repaired_like_a_plain_loop(spark):
    """The whole rule over random names with transpositions: kept if part of a name, else the best of whole names and first words."""
    r = random.Random(4)
    names = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(3, 8))) for _ in range(r.randint(1, 3))) for _ in range(60)] + ["abcde"]
    asked = ["acbde", "zzzzzz", "  ", None]
    for n in names[:50]:
        w = n if r.random() < 0.4 else " ".join(n.split()[: r.randint(1, 2)])
        i = r.randrange(len(w) - 1)
        asked += [w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w]
    got = {x.name: x.repaired for x in routing.repaired_names(spark.createDataFrame([(a,) for a in asked], "name string"), "name", spark.createDataFrame([(n,) for n in names], "name string")).collect()}

    def plain(value):
        h = (value or "").strip()
        if not h or any(h in n for n in names):
            return value
        k = len(h.split(" "))
        tried = {form: SequenceMatcher(None, h, form).ratio() for n in names for form in (n, " ".join(n.split(" ")[:k]))}
        form = min(tried, key=lambda f: (-tried[f], f))
        return form if tried[form] >= 0.8 else value

    assert got == {a: plain(a) for a in asked} and got["acbde"] == "abcde"


def test_fuzzy_names_equal_all_pairs(spark):
    from tessella.functions.text import phonetic
    from pyspark.sql import functions as F

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    words = {w for r in part.select(F.regexp_extract_all(phonetic("p_name"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w")).collect() for w in r.w}
    asked = {w[:2] + "e" + w[2:] for w in words if len(w) >= 4}
    want = {(q, w, round(x, 10)) for q in asked for w in words if abs(len(w) - len(q)) <= max(3, len(q) // 2) and (x := SequenceMatcher(None, q, w).ratio()) >= 0.75}
    assert set(map(tuple, entry.queries()["fuzzy_names"](spark, "/root/testdata/sf0.001").collect())) == want


def test_large_dictionary_without_nested_loops(spark):
    from pyspark.sql import functions as F

    many = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" of")).alias("expr"), F.lit("other").alias("wording"), F.lit(0).alias("pos"))
    asked = spark.createDataFrame([(1, "W12 of, w99999 often"), (2, "w5 w7 or"), (3, None), (4, "of w123456 of"), (5, "w1 w12 of w12 of")], "id int, q string")
    hits = U.trie_matches(asked, "id", "q", many)
    assert {(r.id, r.expr) for r in hits.collect()} == {(1, "w12 of"), (1, "w1 of"), (1, "w99999 of"), (1, "w9999 of"), (1, "w999 of"), (1, "w99 of"), (1, "w9 of"), *((4, f"w{'123456'[:n]} of") for n in range(1, 6)), (5, "w12 of"), (5, "w1 of")}
    out = U.expand(asked, "id", "q", many)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and {r.id: len(r.variants) for r in out.collect()} == {1: 2, 2: 1, 3: 1, 4: 2, 5: 2}


def test_expansion_equals_a_plain_walk(spark):
    r = random.Random(2)
    keys = [" ".join(r.choice(["a", "ab", "b", "Ba", "c-a"]) for _ in range(r.randint(1, 3))) for _ in range(25)] + ["", "?"]
    rows = [(k, f"{k}/{j}", j) for k in dict.fromkeys(keys) for j in range(r.randint(1, 3))]
    asked = [(i, " ".join(r.choice(["a", "abc", "ba", "bac", "c", "á"]) for _ in range(r.randint(0, 6)))) for i in range(60)]
    got = {x.id: x.variants for x in U.expand(spark.createDataFrame(asked, "id int, q string"), "id", "q", spark.createDataFrame(rows, "expr string, wording string, pos int")).collect()}
    import re

    def words(t):
        return re.findall("[a-z0-9]+", t.lower().replace("á", "a"))

    for i, q in asked:
        w, hits = words(q), []
        for k in dict.fromkeys(keys):
            if (p := words(k)) and any(all(x.startswith(y) for x, y in zip(w[at:], p)) for at in range(len(w) - len(p) + 1)):
                hits.append(k)
        want = [q] + [f"{k}/{j}" for k in sorted(hits, key=lambda k: (-len(k), k)) for j in range(sum(x[0] == k for x in rows))]
        assert got[i] == list(dict.fromkeys(want))[:5]
