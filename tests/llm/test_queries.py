"""The registered queries against their SQL, and the pipeline on odd rows."""

import os

import duckdb
import pytest

import corpus_pipeline
from quern.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    cursor = con.execute(queries.ORACLES[name])
    assert sorted(c[0] for c in cursor.description) == names
    order = sorted(range(len(names)), key=lambda k: cursor.description[k][0])
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(repr(tuple(r[k] for k in order)) for r in cursor.fetchall())


def write(spark, folder, docs):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, template string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_on_odd_rows(spark, tmp_path):
    plain = "a text of its own with more than five words"
    docs = [(1, None), (2, ""), (None, plain), (None, None), (5, plain), (5, plain), (6, plain + " and one"), (7, "say alpha beta gamma delta epsilon zeta now"), (8, "x " * 200_000), (9, "four words are here")]
    folder = write(spark, tmp_path, [(*d, None, None, None, "clash", None) for d in docs])
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect() if r.doc_id is not None)
    # The two rows of 5 are one after exact dedup, 6 is linked with it; of the empty ones the one with the largest id stays.
    assert [i for i, _ in got] == [2, 5, 8, 9]
    assert corpus_pipeline.run(spark, folder).count() == 4  # no row without an id stays, as equal texts have one


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_toxicity_on_held_out_labels(spark):
    """Recall and precision at the threshold on labels that were never learned from."""
    sf = "/root/testdata/sf0.1"
    found = queries.QUERIES["op7_crf_toxicity"](spark, sf).where("held_out").select("doc_id", "predicted")
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) >= 0.9
