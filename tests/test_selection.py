"""Ranks of groups, canonical objects and heading pages against plain versions."""

import json
import random


from tessella.operators import conversion as C
from tessella.operators import quality as Q
from tessella.operators.selection import at_ranks


def test_ranks_equal_sorted_groups(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]) if i % 3 else "a", r.choice([None, 1.0, 1.0, r.random() * 100, -5.5]), i) for i in range(3_000)] + [("one", 7.0, 9_999)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    groups = {g: sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2])) for g in ("a", "b", None, "one")}
    wanted = [(g, n, f"{g}{n}") for g, xs in groups.items() for n in {1, 2, len(xs) // 2, len(xs) * 9 // 10, len(xs), len(xs) + 1, 0}]
    got = {x.name: (x.v, x.i) for x in at_ranks(df, "g", "v", ["i"], spark.createDataFrame(wanted, "g string, rank int, name string"), buckets=16).collect()}
    assert got == {name: groups[g][n - 1][1:] for g, n, name in wanted if 1 <= n <= len(groups[g])}


def test_objects_in_any_key_order_are_one(spark):
    texts = ['{"a": 1, "b": {"d": [1, 2], "c": "x"}}', '{"b":{"c":"x","d":[1,2]},"a":1}', '{"b":{"c":"x","d":[2,1]},"a":1}', "{broken", "{broken", None, "[]", '{"a": 1, "b": null}', '{"a": 1}', '"ž"', "", '{"a": 1},', "1, null", '{"a": 1} {}', "null", " 1.50 "]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts)], "i int, k string, t string")
    got = {r.i: (r.canonical, r.broken) for r in Q.unique_objects(df, ["k"], "t", "i").collect()}
    assert sorted(got) == [0, *range(2, 16)]
    for i, (canonical, broken) in got.items():
        assert broken == (i in (3, 4, 10, 11, 12, 13)) and (broken or i == 5 or json.loads(canonical) == json.loads(texts[i]))
    assert got[0][0] == '{"a":1,"b":{"c":"x","d":[1,2]}}'


def test_heading_pages_go_on_from_the_last(spark):
    r = random.Random(8)
    docs = {0: (["a b", "kids"], ["kids x", "the A  B here", "KIDS"])}
    for d in range(1, 40):
        words = "ab cd ef gh".split()
        docs[d] = ([r.choice([*words, "nowhere", ""]) for _ in range(r.randint(0, 8))], [" ".join(r.choice(words) for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 6))])
    h = spark.createDataFrame([(d, i, x) for d, (hs, _) in docs.items() for i, x in enumerate(hs)], "d int, pos int, heading string")
    p = spark.createDataFrame([(d, i + 1, t) for d, (_, ps) in docs.items() for i, t in enumerate(ps)], "d int, page int, text string")
    want = set()
    for d, (hs, ps) in docs.items():
        at, found = 0, {}
        for x in hs:
            for i in range(at, len(ps)):
                if x and x in " ".join(ps[i].lower().split()):
                    found.setdefault(x, i + 1)
                    at = i
                    break
        want |= {(d, x, n) for x, n in found.items()}
    assert {tuple(x) for x in C.heading_pages(h, p, "d").collect()} == want and (0, "kids", 3) in want
