"""The pipeline on planted cases, and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import prose


def test_pipeline_on_planted_cases(spark, tmp_path):
    item = prose(99_999, 24)
    clean = [(i, "\n".join(prose(100 * i + k, 40) + "." for k in range(3)), "en", "s", 0) for i in range(1, 40)]
    copies = [(100, clean[0][1], "en", "s", 0), (101, clean[1][1].replace(" ", "  ", 5), "en", "s", 0)]
    near = [(102, clean[2][1] + "\n" + prose(7, 6), "en", "s", 0)]
    leaked = [(103, prose(8, 60) + " " + item.upper() + " " + prose(9, 60), "en", "s", 0)]
    junk = [(200 + i, " ".join(w.upper() + "!!" for w in prose(300 + i, 50).split()), "en", "s", 0) for i in range(40)]
    odd = [(300, None, None, None, None), (301, "", "en", "s", 0)]
    docs = spark.createDataFrame(clean + copies + near + leaked + junk + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d[0], 1, 0) for d in clean] + [(d[0], 0, 0) for d in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in rows.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == docs.columns
    ids = {d[0] for d in clean}
    assert not kept[0] & {d[0] for d in junk} and ids <= kept[0]
    assert not kept[1] & {100, 101} and ids <= kept[1]
    assert 103 in kept[2] and 103 not in kept[3] and ids <= kept[4]
    again = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert again == kept[4]


def test_registered():
    names = entry.queries()
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {n.split("_")[0] for n in names}
    assert set(entry.oracle_sql()) <= set(names)
