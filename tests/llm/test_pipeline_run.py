"""The registered pipeline query, from its table to its rows."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemo.llm import queries


def folders(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return [d for d, _, _ in os.walk(top) if "pipeline-" in d]


def by_stages(spark, docs, data):
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema) if stage is not corpus_pipeline.encode else stage(spark, docs, data)
    return Counter((r.doc_id, tuple(r.token_ids), r.decoded_sha256) for r in docs.collect())


def test_query_gives_the_stages_rows(spark, data):
    got = queries.queries()["pipeline"](spark, data)
    want = by_stages(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
    assert Counter((r.doc_id, tuple(r.token_ids), r.decoded_sha256) for r in got.collect()) == want and len(want) > 100
    assert not folders(spark)


def test_empty_and_clashing_tables(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for c in ("fp", "score", "kept", "token_ids", "rate", "rep", "size", "predicted", "n_words"):
        docs = docs.withColumn(c, F.lit("mine"))
    odd = docs.limit(40).union(docs.limit(3)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).union(docs.limit(1).withColumn("source", F.lit(None).cast("string")))
    labels = spark.read.parquet(f"{data}/labels.parquet")
    for name, table in (("none", docs.limit(0)), ("odd", odd)):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        rows = queries.queries()["pipeline"](spark, folder).collect()
        assert bool(rows) == (name == "odd") and not folders(spark)
        assert len({r.doc_id for r in rows}) <= 40


def test_tables_go_when_a_stage_fails(spark, data, monkeypatch):
    def broken(spark, docs, sf_dir):
        raise ValueError("no")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("broken", broken), *corpus_pipeline.STAGES[3:]])
    with pytest.raises(ValueError):
        corpus_pipeline.run(spark, data)
    assert not folders(spark)
