"""The stages on a small corpus, and the SQL of the mixing query."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrafold.llm import queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables")


def test_stages_keep_columns_and_act(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(SF)), name)
        assert docs.columns == first.columns and docs.dtypes == first.dtypes
        counts.append(docs.count())
    assert counts[0] <= first.count() and counts[1] < counts[0] and counts[2] == counts[1]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_stages_take_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some words here", "en", "a", 15), (3, "some words here", "en", "a", 15), (None, "x y", None, "a", 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(SF)), name)
    assert {r.doc_id for r in docs.collect()} == {3}


def test_mixing_is_what_sql_says(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.sql(queries.SQL["op8_mix"]).df().sort_values("doc_id")
    ours = queries.QUERIES["op8_mix"](spark, str(SF)).toPandas().sort_values("doc_id")
    for c in ours.columns:
        assert ours[c].tolist() == theirs[c].tolist(), c


#: Queries whose rows are no documents: vectors, and steps of filter orders. Their rows are compared with SQL.
OTHER_ROWS = {"op12_dual_tree", "op13_filter_audit"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - OTHER_ROWS))
def test_each_document_once(spark, name):
    got = queries.QUERIES[name](spark, str(SF))
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.select("doc_id").distinct().count() == n
    if name != "op9_packing":
        assert got.count() == n
    assert not any(t.startswith(("array", "map", "struct")) for _, t in got.dtypes) and got.where(F.col("doc_id").isNull()).count() == 0


def test_second_stage_does_not_shuffle_every_key(spark):
    """Keys of n-grams that one document only has travel packed, and documents with them stay."""
    def written():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    texts = [(i, " ".join(f"w{i * 7919 % 997}x{k}" for k in range(300))) for i in range(120)]
    texts += [(120 + i, texts[i][1] + " end") for i in range(10)]
    docs, before = spark.createDataFrame(texts, "doc_id long, text string"), written()
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(120)]
    assert 0 < sum(n for k, n in written().items() if k not in before) < 120 * 90
