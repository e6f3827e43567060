"""Exact dedup, SimHash and line dedup against brute force."""

import hashlib
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tessella.llm import exact_dedup, line_dedup, simhash
from tessella.llm.common import connected_components


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (5, 5), (20, 7), *[(100, 100 + i) for i in range(1, 60)]]
    df = spark.createDataFrame([*edges, (None, 3), (2, 1)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n != 5}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_exact_dedup(spark, edge_docs, edge_rows, empty_docs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in edge_rows:
        groups.setdefault(norm(t), []).append(i)
    for capacity in (20_000, 1):  # the second splits every bucket
        got = exact_dedup.exact_duplicates(edge_docs, capacity=capacity).collect()
        want = []
        for i, t in edge_rows:
            g = groups[norm(t)]
            keep = min((x for x in g if x is not None), default=None)
            want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert exact_dedup.exact_duplicates(empty_docs).count() == 0


def test_directory_splits(spark):
    entries = spark.range(2000).selectExpr("xxhash64(id) AS h")
    leaves = exact_dedup.build_directory(entries, 50).collect()
    keys = [r.h & 0xFFFFFFFFFFFFFFFF for r in entries.collect()]
    held = {(r.depth, r.prefix): sum(k >> (64 - r.depth) == r.prefix for k in keys) for r in leaves}
    assert sum(held.values()) == 2000 and max(held.values()) <= 50


def naive_fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_match_definition(edge_rows):
    for _, t in edge_rows:
        if not t or len(t) < 100_000:
            assert simhash.fingerprint(t) == naive_fingerprint(t)


def test_covering_masks_cover():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    r = np.random.default_rng(0)
    for _ in range(2000):
        diff = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
        assert any(m & diff == 0 for m in masks)
    small = simhash.covering_masks(2)
    for bits in combinations(range(64), 2):
        assert any(m & sum(1 << b for b in bits) == 0 for m in small)


def test_near_duplicates(spark, edge_docs, edge_rows, empty_docs):
    fps = [(i, simhash.fingerprint(t)) for i, t in edge_rows]
    ids = [i for i, _ in fps if i is not None]
    links = [(a, b) for (a, x), (b, y) in combinations(fps, 2) if a is not None and b is not None and bin(x ^ y).count("1") <= 4]
    want = components(set(ids), links)
    for pairwise in (256, 1):  # the second sends every bucket through half-radius balls
        got = simhash.near_duplicates(edge_docs, pairwise=pairwise).collect()
        assert {r.id: r.component_id for r in got if r.id is not None} == want
        assert len(got) == len(edge_rows)
    assert simhash.near_duplicates(empty_docs).count() == 0


def test_similar_documents(spark, edge_docs, edge_rows, empty_docs):
    """Against all pairs: fingerprints within four bits, or five-word Jaccard of 0.8 or more; with crowded buckets too."""
    r = np.random.default_rng(3)
    rows = [(i, t) for i, t in edge_rows if i is not None]
    number = 1000
    for base, copies in [(50, 4), (60, 40), (70, 30)]:
        words = prose(base, 120).split()
        for _ in range(copies):
            own = list(words)
            for k in r.choice(len(own), int(r.integers(1, 4 if base < 70 else 8)), replace=False):
                own[int(k)] = f"w{int(r.integers(1 << 30))}"
            rows.append((number, " ".join(own)))
            number += 1
    hashed = [(i, simhash.fingerprint(t, 5), set(simhash.shingle_hashes(t, 5).tolist())) for i, t in rows]
    links = [
        (a, b)
        for (a, x, p), (b, y, q) in combinations(hashed, 2)
        if (x ^ y).bit_count() <= 4 or (p and q and 5 * len(p & q) >= 4 * len(p | q))
    ]
    want = components({i for i, _ in rows}, links)
    beyond = components({i for i, _ in rows}, [(a, b) for (a, x, _), (b, y, _) in combinations(hashed, 2) if (x ^ y).bit_count() <= 4])
    assert len(set(beyond.values())) > len(set(want.values())) + 10  # the fingerprint alone leaves most apart
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.similar_documents(docs).collect()
    assert len(got) == len(rows) and {x.id: x.component_id for x in got} == want
    assert sorted((x.id is None, x.id) for x in simhash.similar_documents(edge_docs).collect() if x.id is not None) == sorted((False, i) for i, _ in edge_rows if i is not None)
    assert simhash.similar_documents(empty_docs).count() == 0


def test_links_against_all_pairs(spark):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 1 << 63, 30)]
    fps = {b ^ sum(1 << int(k) for k in r.choice(64, int(r.integers(0, 7)), replace=False)) for b in base for _ in range(15)}
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "fp long, rep long")
    near = [(i, j) for (x, i), (y, j) in combinations(rows, 2) if bin((x ^ y) & 0xFFFFFFFFFFFFFFFF).count("1") <= 4]
    want = components({i for _, i in rows}, near)
    for pairwise in (256, 4, 1):
        found = [(e.a, e.b) for e in simhash.links(df, 4, pairwise).collect()]
        assert components({i for _, i in rows}, found) == want
    near3 = [(i, j) for (x, i), (y, j) in combinations(rows, 2) if bin((x ^ y) & 0xFFFFFFFFFFFFFFFF).count("1") <= 3]
    found = [(e.a, e.b) for e in simhash.links(df, 3, 1).collect()]  # an odd radius has two ball sizes
    assert components({i for _, i in rows}, found) == components({i for _, i in rows}, near3)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def line_norm(t):
    return re.sub(" +", " ", re.sub(r"[!-/:-@\[-`{-~\x00-\x1f]+", "", t.lower())).strip(" ")


def similar_pairs(texts, similarity=0.8):
    """All pairs within the edit similarity; bigram counts, which an edit changes by four at most, rule most of them out."""
    texts = sorted(texts, key=len)
    grams = np.zeros((len(texts), 512), np.int16)
    for i, t in enumerate(texts):
        for x, y in zip(t, t[1:]):
            grams[i, (ord(x) * 31 + ord(y) * 17) % 512] += 1
    sizes = np.array([len(t) for t in texts])
    for i, x in enumerate(texts):
        end = int(np.searchsorted(sizes, int(len(x) / similarity) + 1, side="right"))
        budget = np.floor((1 - similarity) * sizes[i + 1 : end] + 1e-9)
        for j in np.flatnonzero(np.abs(grams[i + 1 : end] - grams[i]).sum(axis=1) <= 4 * budget) + i + 1:
            if edit_distance_fast(x, texts[j]) <= int((1 - similarity) * len(texts[j]) + 1e-9):
                yield x, texts[j]


def edit_distance_fast(a, b):
    """Edit distance by bit vectors (Hyyro's form)."""
    masks = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = masks.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return score


def test_fast_edit_distance():
    r = np.random.default_rng(5)
    for _ in range(300):
        a, b = ("".join(r.choice(list("abc"), int(r.integers(1, 20)))) for _ in range(2))
        assert edit_distance_fast(a, b) == edit_distance(a, b)


def brute_lines(rows, similarity=0.8):
    """What must be removed, by comparing all pairs of lines."""
    occ = [(i, n, line_norm(x)) for i, t in rows for n, x in enumerate((t or "").split("\n")) if line_norm(x)]
    comp = components({o[2] for o in occ}, similar_pairs({o[2] for o in occ}, similarity))
    first = {}
    for i, n, x in sorted(occ, key=lambda o: (o[0] is not None, o[0] or 0, o[1])):
        first.setdefault(comp[x], (i, n))
    return sorted({repr((i, n)) for i, n, x in occ if first[comp[x]] != (i, n)})


def removed(docs):
    return sorted(repr((r.id, n)) for r in line_dedup.dedup_lines(docs).collect() for n in r.removed)


def test_line_dedup(spark):
    base = [prose(s, 25) for s in range(6)]
    family = [base[0].replace(w, w + "x", 1) for w in base[0].split()[:12]]
    long_ = prose(50, 260)
    rows = [(1, "\n".join([base[0], base[1], "short", "---"])), (2, "\n".join([base[1].upper() + "!!", family[0], "short", "---"])), (3, "\n".join([base[2], *family[1:8]])),
            (4, long_ + "\n" + base[3]), (5, long_.replace(long_.split()[100], "zzzz")), (6, None), (7, ""), (8, "\n".join([base[4], base[4], base[5]])), (9, "\n".join(family[8:]))]
    df = spark.createDataFrame([(i, t, "n", 5) for i, t in rows], "doc_id long, text string, norm string, n_removed int")
    assert removed(df) == brute_lines(rows)
    out = {r.doc_id: r for r in line_dedup.clean_lines(df, counts=("all", "gone")).collect()}
    assert out[6].text is None and out[7].text == "" and out[1].text == rows[0][1]
    assert out[2].text == "---" and out[2].gone == 3 and out[8].text == base[4] + "\n" + base[5]
    assert out[1].n_removed == 5  # a column of the input stays as it is
    assert line_dedup.clean_lines(df.limit(0)).count() == 0


def test_line_dedup_edges(spark, edge_docs, edge_rows):
    """Null ids, repeated rows, blank and very long lines, clashing column names."""
    out = line_dedup.clean_lines(edge_docs).collect()
    assert len(out) == len(edge_rows) and out[0].__fields__ == [*edge_docs.columns, "n_lines", "n_removed"]
    assert {(r.doc_id, r.n_removed) for r in out} >= {(7, 0), (8, 0), (9, 0), (10, 0), (11, 0), (12, 0), (None, 0), (3, 1), (5, 1)}
    # rows equal in id and text are one document: both keep or lose the same
    assert len({(r.text, r.n_removed) for r in out if r.doc_id == 2}) == 1
    assert [r.text for r in out if r.doc_id == 14] == [""] and [r.text for r in out if r.doc_id == 9] == [" \t\n "]
    names = spark.createDataFrame([(1, "a line of words", 1, 2, 3), (2, "a line of words", 1, 2, 3)], "doc_id long, text string, row int, removed int, gone_id int")
    assert sorted((r.doc_id, r.text, r.removed) for r in line_dedup.clean_lines(names).collect()) == [(1, "a line of words", 2), (2, "", 2)]


def test_line_dedup_across_lengths(spark):
    """Near lines on both sides of any length are compared, in characters."""
    a = prose(61, 180)[:1001].strip()
    rows = [(1, a), (2, a[:-12]), (3, prose(62, 3000)), (4, prose(62, 3000).replace("alp", "xyz", 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(df) == brute_lines(rows) == ["(2, 0)", "(4, 0)"]


def test_large_buckets_stay_connected(spark):
    """A family far larger than what a line meets in a bucket ends in one group."""
    words = prose(70, 40).split()
    rows = [(i, " ".join([*words[: i % 40], prose(5000 + i, 1) + str(i), *words[i % 40 + 1 :]])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(removed(df)) == 399


def test_line_blocks_by_definition(spark):
    """Blocks against a plain computation: majority fingerprints of word classes, and which of them two lines share."""
    texts = [prose(200 + k, n) for k, n in enumerate((1, 3, 9, 20, 45, 90, 300))]
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line long, norm string").repartition("line")
    got = {}
    for r in line_dedup.line_blocks(lines).collect():
        got.setdefault(r.line, []).append((r.mark % 2 == 1, r.mark // 16 % 128))
    for k, t in enumerate(texts):
        words, want = set(t.split(" ")), []
        for bits in {max(0, int(np.floor(np.log2(len(words) * f / line_dedup.CLASS_WORDS)))) for f in (1, 1.25)}:
            classes = [spark_hash(w) & ((1 << bits) - 1) for w in words]
            sizes = [classes.count(c) for c in set(classes) if c < line_dedup.BLOCKS]
            want += [(bool(bits % 2), n) for n in sizes if n >= min(len(words), line_dedup.BLOCK_WORDS)]
        assert sorted(got[k]) == sorted(want)


def spark_hash(word):
    return xxhash.xxh64_intdigest(word.encode(), 42)


def test_line_recall_against_all_pairs(spark):
    """250 documents of the test data: groups against edit similarity over all pairs of lines."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 250 AND text IS NOT NULL")
    texts = {line_norm(x) for r in docs.collect() for x in r.text.split("\n")} - {""}
    pairs = list(similar_pairs(texts))
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(sorted(texts))], "line long, norm string").repartition("line")
    found = components(texts, [(r.x, r.y) for r in line_dedup.line_links(lines, 0.8).collect()])
    hit = sum(found[x] == found[y] for x, y in pairs)
    assert len(pairs) >= 30 and hit >= 0.9 * len(pairs), (hit, len(pairs))


def test_line_links_are_similar(spark):
    """Every link reaches the similarity, whichever of the tests settles it; word swaps in lines of many lengths are found."""
    r, families = np.random.default_rng(3), []
    for f in range(20):
        words = prose(1000 + f, 15 + 2 * f).split()
        families.append([" ".join([*words[:k], prose(int(r.integers(1 << 30)), 1), *words[k + 1 :]]) for k in r.choice(len(words), 3, replace=False)])
    texts = {t for g in families for t in g}
    pairs = {frozenset(p) for p in similar_pairs(texts)}
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(sorted(texts))], "line long, norm string").repartition("line")
    links = {frozenset((x.x, x.y)) for x in line_dedup.line_links(lines, 0.8).collect()}
    group = components(texts, map(tuple, links))
    found = sum(len({group[t] for t in p}) == 1 for p in pairs)
    assert len(pairs) >= 50 and links <= pairs and found >= 0.85 * len(pairs), (len(pairs), len(links), found, len(links - pairs))
    r = np.random.default_rng(4)
    some = []
    for _ in range(300):  # random edits of words and characters
        words = prose(int(r.integers(1 << 30)), int(r.integers(1, 12))).split()
        other = [w if r.random() > 0.3 else w[: int(r.integers(0, len(w)))] + "q" for w in words if r.random() > 0.08] or ["q"]
        some.append((" ".join(words), " ".join(other)))
    got = spark.createDataFrame(some, "x string, y string").select("x", "y", line_dedup.similar(F.col("x"), F.col("y"), 0.8).alias("ok")).collect()
    for g in got:
        v, w = set(g.x.split(" ")), set(g.y.split(" "))
        shared = len(v & w) >= line_dedup.WORD_SHARE * max(len(v), len(w))
        assert g.ok == (shared and edit_distance(g.x, g.y) <= int(0.2 * max(len(g.x), len(g.y)) + 1e-9)), g
