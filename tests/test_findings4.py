"""Findings of round 4: odd letters and lines against DuckDB, and work that must not grow with a table."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.functions import text as T
from tessella.operators import filling, fulltext, nearest
from tests.test_filling import loop


def same_as_sql(spark, root, name, **tables):
    """Rows of a query over these tables (name to rows and schema), which must be those of its SQL."""
    duck = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet/*.parquet'")
    got, ref = entry.queries()[name](spark, str(root)), duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in ref.description]
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    assert rows == sorted(map(repr, ref.fetchall()))
    return rows


def test_upper_case_of_one_letter(spark, tmp_path):
    """letters whose upper case is several letters in Spark and one, or none, in DuckDB."""
    words = ["schßein, x", "ŉa b", "ﬁn z", "ΑΣ y", "οδός y", "İi y", "ᾳ y", "plain words", " y", "", None, "ǆ " + "ß" * 80]
    docs = [(i, w) for i, w in enumerate(words * 3)]
    labels = [(i, i // len(words)) for i in range(2 * len(words))]
    same_as_sql(spark, tmp_path, "item_text_join", documents=(docs, "doc_id long, text string"), labels=(labels, "doc_id long, quality int"))


def test_simple_case_of_every_letter(spark):
    letters = [(i, chr(i)) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame(letters, "i int, c string").select("i", T.simple_upper("c").alias("up"), T.simple_lower("c").alias("low"))
    duck = duckdb.sql("SELECT i, upper(chr(i)), lower(chr(i)) FROM (SELECT unnest(range(1, 131072))::INT AS i) WHERE NOT i BETWEEN 55296 AND 57343").fetchall()
    assert [tuple(r) for r in rows.orderBy("i").collect()] == sorted(duck)


def test_bold_line_with_a_line_end(spark, tmp_path):
    """a bold line with a line feed in it stayed as it was; odd white space at its end made a heading."""
    words = ["Esing.\nTionertion", "a\rb", "a\u2028b", "\u00a0", "x\u3000", "a\x0bb", "a\u0085", "", "plain", "a\t\n", "**1.\t**\n", "**1.\t**", None, "\u2003x"]
    turns = [(c, t, "user", w and f"{w} rest") for c, w in enumerate(words) for t in range(8)]
    rows = same_as_sql(spark, tmp_path, "promote_headings", conversations=(turns, "conv_id long, turn int, role string, text string"))
    assert any("'## 4.0 Esing. Tionertion'" in r for r in rows)


def vectors(n, odd=True):
    """(vec_id, label, embedding): few directions, so that many cosines are equal; zero and missing vectors among them."""
    r = random.Random(5)
    some = [[float(r.choice([-1, 0, 1, 2])) for _ in range(6)] for _ in range(25)]
    rows = [(i, i % 3, r.choice(some)) for i in range(n)]
    return [(i, k, None if odd and i in (7, 100) else v) for i, k, v in rows]


@pytest.mark.parametrize(("name", "n", "odd"), [(q, n, odd) for q in ("precision_at_k", "threshold_sweep") for n, odd in ((0, False), (1, False), (4, True), (9, True), (400, True), (400, False))])
def test_all_pairs_against_sql(spark, tmp_path, monkeypatch, name, n, odd):
    """several blocks, equal cosines and missing vectors give the rows of the SQL."""
    monkeypatch.setattr(nearest, "ROWS", 90)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    rows = [(i, k, v if v is None or any(v) else [1.0] * 6) for i, k, v in vectors(n, odd)]
    same_as_sql(spark, tmp_path, name, embeddings=(rows, "vec_id long, label int, embedding array<float>"))


def test_pairs_of_vectors_do_not_become_rows(spark, tmp_path):
    """every pair was a row of a join, and its cosine was folded from arrays (29 microseconds a pair)."""
    spark.createDataFrame(vectors(120), "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("precision_at_k", "threshold_sweep"):
        plan = entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_zero_vectors_come_first(spark):
    rows = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.0, 0.0]), (3, 1, None), (4, 1, [1.0, None]), (5, 2, [1.0])], "vec_id long, label int, embedding array<double>")
    q = rows.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"), F.col("embedding").alias("qe"))
    got = [(r.vec_id, r.label, repr(r.s)) for r in nearest.nearest(q, rows, 4).collect()]
    assert sorted(got) == [(1, 1, "1.0"), (2, 2, "nan"), (3, 1, "None"), (4, 1, "None")]
    (r,) = nearest.over_thresholds(q.drop("truth"), rows.drop("label"), [0.0, 0.5, 1.1]).collect()
    assert tuple(r) == (0, 5, [2, 2, 1])


@pytest.mark.parametrize("seed", range(8))
def test_batches_over_many_parts(spark, monkeypatch, seed):
    """F8: batches that begin, end or go on over parts of a few rows; both ways equal a loop."""
    monkeypatch.setattr(filling, "PART_ROWS", 48)
    r = random.Random(seed)
    cap, size = r.choice([100, 7, 30]), r.choice([1, 2, 5, 6])
    weights = [[60], [1, 2, 3], [0, 0, 100, 250], [None, 5, 99, 101], [100, 1], [3], [0], [0.5, 1.25]][seed]
    rows = [(r.randint(0, 40), i, float(w) if (w := r.choice(weights)) is not None else None, r.randint(0, 9), r.random() < 0.1) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, id long, w double, usd long, bad boolean").repartition(3)
    got = {x.id: (x.batch, x.state) for x in filling.filled(df, "k", ["id"], "w", cap, size, fault=F.col("bad"), cost="usd", ceiling=500, parts=2).collect()}
    assert got == loop([x[1:] for x in sorted(rows)], cap, size, 500)


def test_batches_take_a_fixed_number_of_jobs(spark):
    """F8: the jobs numbered the logarithm of the batches, and each went over a pointer per row."""
    df = spark.range(3000).withColumn("w", F.lit(1))
    tracker, group = spark.sparkContext.statusTracker(), "filling-jobs"
    spark.sparkContext.setJobGroup(group, "")
    out = filling.filled(df, "id", [], "w", 2, 10, ceiling=None, parts=4)
    assert out.where("batch = id div 2 + 1").count() == 3000
    assert len(tracker.getJobIdsForGroup(group)) < 45
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


TEXTS = [
    (1, "That une pour Žábas berries with that"), (2, "que por una que por une"), (3, "the of und"), (2, "que that other words"), (None, "une that"), (None, "pour une"), (4, None), (5, ""),
    (6, "items answered une, unanswered item ITEMS"), (7, "ein wörter Wörter worter " * 30), (8, "that"),
]


@pytest.mark.parametrize("flush", [1, 7, 1000])
@pytest.mark.parametrize("special", [0, 10**6])
def test_index_of_repeated_ids_and_small_flushes(spark, tmp_path, monkeypatch, flush, special):
    """hits are grouped where documents are read, whatever the flush, the documents of one id and the size of the dictionary."""
    monkeypatch.setattr(fulltext, "FLUSH", flush)
    monkeypatch.setattr(fulltext, "SPECIAL", special)
    monkeypatch.setattr(fulltext, "DOCUMENTS", 3)
    items = [(0, "answer item of the word unit berries")]
    rows = same_as_sql(spark, tmp_path, "lexemes", documents=(TEXTS, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    assert any("'worter', 1, 120" in r or "'worter', 1, 240" in r or "'worter', 1, 180" in r for r in rows)
    texts = [(i, t) for i, t in TEXTS if i is not None]
    same_as_sql(spark, tmp_path / "b", "index_ranks", documents=(texts, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))


def test_hits_are_not_shuffled(spark, tmp_path):
    """every hit of a word was shuffled three times; now counts of words and of terms are, and special words are."""
    same_as_sql(spark, tmp_path, "lexemes", documents=([x for x in TEXTS if x[0] not in (2, None)], "doc_id long, text string"), benchmark=([(0, "answer item")], "item_id long, text string"))
    plan = entry.queries()["lexemes"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" in plan and "SortMergeJoin" not in plan
