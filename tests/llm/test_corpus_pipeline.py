"""The pipeline's stages against plain versions, and its registration."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from rosterline.llm import exact_dedup, queries
from rosterline.llm.common import store
from tests.llm.test_llm_operators import SCHEMA, awkward, union
from tests.llm.test_near_copies import plain_links

TABLES = "/root/testdata/sf0.001"


def test_stages_hand_on(spark):
    docs, before = spark.read.parquet(f"{TABLES}/documents.parquet"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, store(stage(spark, docs, TABLES), "stage-test")
        if name != "packing":
            assert docs.columns == columns
        if name == "exact dedup":
            best = before.groupBy("text").agg(F.max("doc_id").alias("doc_id"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in best.collect()}
        if name == "simhash near-dedup":
            texts = {r.doc_id: r.text for r in before.collect()}
            want = set(union(plain_links(texts), texts).values())
            assert {r.doc_id for r in docs.collect()} == want and len(want) < len(texts)
        if name == "mixing":
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        if name == "packing":
            assert Counter(r.doc_id for r in docs.filter("start = 0").collect()) == Counter(
                r.doc_id for r in before.collect()
            )


def test_quality_keeps_clean_documents(spark):
    tables = TABLES.replace("sf0.001", "sf0.01")  # the smallest tables hold a dozen bad rows only
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, tables).collect()}
    labels = spark.read.parquet(f"{tables}/labels.parquet").collect()
    assert all(r.doc_id in kept for r in labels if r.quality == 1)
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_stages_take_awkward_and_empty_tables(spark):
    for rows in (awkward(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            docs = store(stage(spark, docs, TABLES), "stage-test")
            assert name == "packing" or docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert (docs.count() == 0) == (not rows)


def test_run_and_registration(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert names["pipeline"](spark, TABLES).count() > 0


def test_dropped_tables_leave_results(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    kept = exact_dedup.drop_copies(docs)
    corpus_pipeline.run(spark, TABLES)
    assert kept.count() == docs.select("text").distinct().count()
