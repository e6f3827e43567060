"""URL filters, token alignment and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from tessella.llm import line_dedup, pii_surrogates, sentencepieces, spelling, token_alignment, url_filter

SF = "/root/testdata/sf0.001"


# Spelling variants -----------------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_vocabulary(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def plain_variants(n):
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_variants_equal_all_pairs(spark):
    r = random.Random(5)
    words = {"".join(r.choice("abà") for _ in range(r.randint(6, 8))): r.choice([5, 6, 30, 31, 200, 1200, 7000]) for _ in range(700)}
    words |= {"aaaaaa": 7, "aaaaaaa": 40, "aaaaaaaa": 300, "x" * 80: 9, "x" * 81: 50, "x" * 40 + "y" + "x" * 39: 5, "ßaaaaa": 6}
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert len(got) == len(words) and set(map(tuple, got)) == plain_variants(words)


def test_variants_of_documents(spark):
    got = spelling.op13_spelling_variants(spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(plain_vocabulary(rows))
    assert len(got) == len(want) > 50 and set(map(tuple, got)) == want


def test_variants_edges(spark, edge_docs, edge_rows, empty_docs):
    found = spelling.with_slips(spelling.runs(edge_docs, "doc_id", "text", 6))
    n = plain_vocabulary(edge_rows)
    got = {r.word: r.n for r in spelling.vocabulary(found).collect()}
    assert got == n
    assert spelling.group_variants(spelling.vocabulary(spelling.with_slips(spelling.runs(empty_docs, "doc_id", "text", 6)))).count() == 0
    long = "ab" * 4_000
    some = spark.createDataFrame([(long, 5), (long[1:], 25), (None, 9)], "word string, n long")
    assert {(r.word, r.form) for r in spelling.group_variants(some).collect()} == {(long, long[1:]), (long[1:], None)}


# URL filters -----------------------------------------------------------------------------------------------------


def plain_judge(pages, rules, share):
    """(host, path, rule, verdict, trust, distrust) of each (url, html)."""
    def parse(url):
        if url is None or "://" not in url:
            return "", ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path

    parsed = [parse(u) for u, _ in pages]
    hits = []
    for host, path in parsed:
        fit = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        hits.append(min(fit)[1:] if fit else (None, None))
    links = Counter()
    for (host, _), (_, html) in zip(parsed, pages):
        if host:
            links.update((host, t) for t in set(re.findall(url_filter.HREF, html or "")))
    edges, named = Counter(), defaultdict(Counter)
    for (host, t), n in links.items():
        if m := re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", t):
            if m[1].lower() not in ("", host):
                edges[host, m[1].lower()] += n
        elif t[0] not in "?#":
            path = re.split("[?#]", t)[0]
            named[path if path.startswith("/") else ":" + path][host] += n
    for node, hosts in named.items():
        for h, n in hosts.items() if len(hosts) > 1 else ():
            edges[h, node] += n
            edges[node, h] += n
    ranks = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        step = {(a, b) if kind == "trust" else (b, a): n for (a, b), n in edges.items()}
        out = Counter()
        for (a, _), n in step.items():
            out[a] += n
        votes = Counter(h for (h, _), (_, v) in zip(parsed, hits) if v == verdict)
        start = {h: n / sum(votes.values()) for h, n in votes.items()}
        now = dict(start)
        for _ in range(url_filter.ROUNDS):
            new = {h: 0.15 * x for h, x in start.items()}
            for (a, b), n in step.items():
                if a in now:
                    new[b] = new.get(b, 0) + 0.85 * now[a] * n / out[a]
            now = new
        ranks[kind] = now
    for (host, path), (rule, verdict) in zip(parsed, hits):
        t, d = ranks["trust"].get(host, 0), ranks["distrust"].get(host, 0)
        yield host, path, rule, verdict or ("allow" if t >= share * (t + d) else "block"), t, d


def test_urls_equal_plain_ranks(spark):
    r = random.Random(3)
    hosts = ["a.org", "B.a.org", "c.net", "d.net", "e.com", "f.com", "example.org", "x.example.org", "g.net", "alone.net"]
    pages = []
    for i in range(200):
        host = r.choice(hosts[:9])
        hrefs = [r.choice([f"https://{r.choice(hosts)}/p", f"//{r.choice(hosts).upper()}?q", "/de", "/all", f"/{host}", "up/x#y", "#top", "?q=1", "mailto"]) for _ in range(4)]
        pages.append((f"http://{host}/{r.choice(['fr', 'de', 'es', 'en'])}/{i}{r.choice(['', '?x=://y', '#z'])}", "".join(f"<a class=x href='{h}'>" if i % 2 else f'<A href="{h}">' for h in hrefs)))
    pages += [(None, "<a href='http://c.net'>"), ("c.net/de/", ""), ("http://alone.net", None), ("", None), ("ftp://e.com?x", None), ("http://e.com/de/1\n2", "<a href='/de'>"), pages[0]]
    rules = [*url_filter.RULES, ("c.net", "/en/1", "allow"), ("org", "/fr/", "block"), ("b.a.org", "/", "allow")]
    df = spark.createDataFrame([(i, u, h, 1.0, "x", "y") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, score double, host string, rule string")
    got = {r.id: tuple(r)[1:] for r in url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(pages)
    for i, want in enumerate(plain_judge(pages, rules, url_filter.SHARE)):
        assert got[i][:4] == want[:4] and got[i][4:] == pytest.approx(want[4:])
    assert {g[3] for g in got.values()} == {"allow", "block"}
    assert url_filter.judge(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_urls_of_pages_equal_sql(spark):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = url_filter.op11_url_filter(spark, SF)
    ref = duckdb.execute(url_filter.OP11_SQL)
    assert got.columns == [d[0] for d in ref.description]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, ref.fetchall()))


# Token alignment -------------------------------------------------------------------------------------------------

FILES = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, from whole-text encodings."""
    tokenizer = Tokenizer.from_file(FILES[0])
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    tokens = token_alignment.tokens_of(*FILES)
    found, counts = [], Counter()
    for text in texts:
        a, b = (tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        if not text or any(b"".join(t[i] for i in ids) != (" " + text).encode() for ids, t in ((a, tokens.a_bytes), (b, tokens.b_bytes))):
            found.append(None)
            continue
        end_a, end_b = np.cumsum([len(tokens.a_bytes[i]) for i in a]), np.cumsum([len(tokens.b_bytes[i]) for i in b])
        groups, i, j = [], 0, 0
        for cut in np.intersect1d(end_a, end_b):
            k, m = int(np.searchsorted(end_a, cut)) + 1, int(np.searchsorted(end_b, cut)) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        counts.update(links.keys())
        found.append((len(a), len(b), len(groups), links, ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    for f in found:
        if f is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            yield (*f[:3], sum(f[3].values()), sum(n for p, n in f[3].items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in f[3].items()), hashlib.sha256(f[4].encode()).hexdigest())


@pytest.mark.parametrize("block_chars", [1, 3_000, 10_000_000])
def test_alignment_equals_whole_texts(spark, block_chars):
    texts = [
        None, "", " ", "a", " a", "a  b ", "x" * 3_000, "xy" * 700 + " z", "a\n\nb\tc", "line\nline two\r\nthree", "<|endoftext|> <s>x</s> <0x41>", "\u2581 lost", "ok \u2581", "短い文 です。 🤗🤗 ﬁ", "e\u0301 é naïve\u00a0café",
        "\u2028odd\u3000spaces\x1cthere", *[prose(i, 60) for i in range(12)], prose(3, 60), prose(9, 4_000), "It's we'll they've 12345 67,8.9 --- ***", None,
    ]
    df = spark.createDataFrame([(i, t, "c", 3) for i, t in enumerate(texts)], "doc_id long, text string, block string, n_a int")
    got, pairs = token_alignment.align(df, *FILES, block_chars=block_chars)
    got = {r.id: tuple(r)[1:] for r in got.collect()}
    assert [got[i] for i in range(len(texts))] == list(plain_alignment(texts))
    assert pairs.where("best").count() > 0


def test_alignment_of_documents(spark, edge_docs, edge_rows, empty_docs):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in token_alignment.op12_token_alignment(spark, SF).collect()}
    assert got == {r.doc_id: want for r, want in zip(rows, plain_alignment([r.text for r in rows]))}
    edge = sorted(map(repr, map(tuple, token_alignment.align(edge_docs, *FILES)[0].collect())))
    assert edge == sorted(repr((i, *want)) for (i, _), want in zip(edge_rows, plain_alignment([t for _, t in edge_rows])))
    out, pairs = token_alignment.align(empty_docs, *FILES)
    assert out.count() == pairs.count() == 0


def test_products_in_runs():
    r = np.random.default_rng(1)
    x, y = r.integers(0, 3, (40, 30)) * (r.random((40, 30)) < 0.3), r.integers(0, 3, (30, 50)) * (r.random((30, 50)) < 0.3)
    a, b = (token_alignment.CSR.of(*np.nonzero(m), m[np.nonzero(m)], m.shape) for m in (x, y))
    for most in (1, 17, 10_000):
        out = np.zeros((40, 50), int)
        for i, j, v in token_alignment.products(a, b, most):
            out[i, j] += v
        assert (out == x @ y).all()
    assert (b.transposed().dot(np.arange(30)) == y.T @ np.arange(30)).all()


# SentencePiece: the table of frequent words ----------------------------------------------------------------------


@pytest.mark.parametrize("most", [0, 3, 7, 11, 1000])
def test_frequent_words_keep_their_bound(spark, most):
    counts = {f"w{i}": 5_000 * (i + 1) for i in range(10)} | {f"t{i}": 40 for i in range(5)} | {"x" * 40: 10**6, "rare": 1}
    got = {r.word for r in sentencepieces.frequent_words(spark.createDataFrame(list(counts.items()), "word string, n long"), most, 32).collect()}
    assert len(got) <= most and "x" * 40 not in got
    assert not got or min(counts[w] for w in got) > max((n for w, n in counts.items() if w not in got and len(w) <= 32), default=0)
    assert {3: 2, 11: 10, 1000: 16}.get(most, 0) <= len(got)


def test_pieces_are_the_library_s_for_any_table(spark):
    texts = [" ".join(f"w{i} common" for i in range(30)) * 40, prose(1, 50), None, "x" * 40]
    library = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for most in (0, 5, 100):  # far more than five words occur over a thousand times
        got = {r.id: r.ids for r in sentencepieces.encode_documents(df, FILES[1], table_words=most).collect()}
        assert got == {i: library.encode(t or "") for i, t in enumerate(texts)}


# Surrogates: mentions without a title, compressed addresses ------------------------------------------------------


def test_names_of_a_document_are_replaced_in_all_forms(spark):
    texts = {
        1: "Herr Hans Keller kam. Keller schrieb, Hans auch; Kellers Haus, keller und HansKeller bleiben. Keller's (Keller)", 2: "Keller und Hans sind hier keine Namen.", 3: None, 4: "Frau Hans kam mit Herr Hans Otto. Hans!",
        5: "г-жа Анна Петрова и Петрова, Анна", 6: "hosts 2001:db8::1, fe80:: and ::1, 2001:db8::1:2 but std::vector, 12:30:45 and a::b", 7: "Mr. A" + " word" * 3 + " Mr. Smith" + " Smith" * 500,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii_surrogates.pseudonymise(df, "k").collect()}
    given, family = re.match(r"Herr (\w+) (\w+) kam", got[1]).groups()
    assert {given, family}.isdisjoint({"Hans", "Keller"})
    assert got[1] == f"Herr {given} {family} kam. {family} schrieb, {given} auch; Kellers Haus, keller und HansKeller bleiben. {family}'s ({family})"
    assert got[2] == texts[2] and got[3] is None and "Hans" not in got[4] and "Otto" not in got[4]
    first, last = re.match(r"г-жа (\w+) (\w+) и", got[5]).groups()
    assert got[5] == f"г-жа {first} {last} и {last}, {first}" and first != "Анна"
    assert re.fullmatch(r"hosts [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f], fe80:: and ::[0-9a-f], [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]:[0-9a-f] but std::vector, 12:30:45 and a::b", got[6].replace(re.search(r"[0-9a-f]{4}:: and", got[6])[0], "fe80:: and"))
    assert "db8" not in got[6] and "Smith" not in got[7] and len(got[7].split()) == len(texts[7].split())


# Lines: short ones with one letter changed -----------------------------------------------------------------------


@pytest.mark.parametrize("n_words", [2, 4, 5, 8])
def test_short_lines_with_an_edit_are_found(spark, n_words):
    r = random.Random(n_words)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 9)))
    texts, pairs = [], []
    for k in range(200):
        words = [word() for _ in range(n_words)]
        i, edit = r.randrange(n_words), k % 3
        at = r.randrange(len(words[i]))
        new = words[i][:at] + ("q" if edit < 2 else "") + words[i][at + (edit != 1) :]
        texts += [" ".join(words), " ".join([*words[:i], new, *words[i + 1 :]])]
        pairs.append((2 * k, 2 * k + 1))
    lines = spark.createDataFrame(list(enumerate(texts)), "line long, norm string").repartition("line")
    links = {(x.a, x.b) for x in line_dedup.line_links(lines, 0.8).collect()}
    similar = [p for p in pairs if texts[p[0]] != texts[p[1]]]
    assert len(links & set(similar)) >= 0.9 * len(similar), len(links & set(similar))
    assert links <= set(similar) | {(a, b) for a, b in links if texts[a] == texts[b]}
