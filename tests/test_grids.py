"""Grids of planted tables, and the agreement of their columns against plain counts."""

from collections import Counter

from pyspark.sql import functions as F

from tessella.operators import grids as G


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("g")).first().g


def test_html_spans_are_filled(spark):
    html = """<p>x</p><TABLE class=a><tr><th colspan=2>A</th><th rowspan="3">B <b>b</b></th></tr><tr><td rowspan='2'>c</td><td>d</td></tr>
    <tr><td>e<td>f</tr></table> between <table><tr><td>1</td></tr><tr></tr><tr><td colspan="0">2</td><td></td></tr></table>"""
    assert one(spark, G.html_grids, html) == [[["A", "A", "B b"], ["c", "d", "B b"], ["c", "e", "B b", "f"]], [["1"], [""], ["2", ""]]]
    assert one(spark, G.html_grids, "no table") == [] and one(spark, G.html_grids, None) is None


def test_markdown_tables(spark):
    text = "a\n| x | y |\n|---|:--:|\n| 1 | |\n text\n|only|\n\n| - | b |"
    assert one(spark, G.markdown_grids, text) == [[["x", "y"], ["1", ""]], [["only"]], [["-", "b"]]]


def plain_words(tables):
    scale = ["velmi časté", "méně časté", "velmi vzácné", "není známo", "časté", "vzácné"]
    name = lambda c: next((k for k in scale if c.lower().strip(" :*#").startswith(k)), None)
    out = {}
    for t in tables:
        head = None
        for r in t:
            f = [name(c) for c in r]
            if sum(x is not None for x in f) >= 2:
                head = f
            elif head and len({c.lower() for c in r if c}) > 1:
                for i, c in enumerate(r):
                    if i < len(head) and head[i] and not f[i]:
                        out.setdefault(head[i], Counter()).update(w for w in c.lower().replace(",", " ").split() if len(w) >= 3)
    return out


def test_agreement_equals_plain_counts(spark):
    ref = "<table><tr><th>Třída</th><th>Velmi časté</th><th>Časté:</th></tr><tr><td colspan=3>Poruchy oka</td></tr><tr><td>oko</td><td>bolest hlavy, bolest</td><td>horečka</td></tr><tr><td>x</td><td>časté</td><td>únava</td></tr></table>"
    var = "| Třída | Velmi časté | Časté |\n|---|---|---|\n| Poruchy oka | Poruchy oka | Poruchy oka |\n| oko | bolest | horečka bolest |\n\n| x | únava | z |"
    d = spark.createDataFrame([(1, ref, var), (2, ref, None), (3, "", var)], "id int, h string, m string").select("id", G.html_grids(F.col("h")).alias("h"), G.markdown_grids(F.col("m")).alias("m"))
    a, b = G.column_words(d, "id", "h"), G.column_words(d, "id", "m")
    got = {r.id: (r.words, r.correct, r.elsewhere, r.missing) for r in G.column_agreement(a, b).collect()}
    assert got == {1: (5, 2, 1, 2), 2: (5, 0, 0, 5)}
    held = {(r.id, r.frequency, r.word): r.n for r in a.collect() if r.id == 1}
    assert held == {(1, f, w): n for f, c in plain_words(d.where("id = 1").first().h).items() for w, n in c.items()}
