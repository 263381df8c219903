"""One query for each corpus operator over its whole table, with production parameters, and the SQL that states the
same result where SQL can."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import query
from . import bpe, chat_format, elkan, embedding_dedup, language_id, licenses, mixing, periodic_runs, quality_classifier, quality_rules, simhash, topk_search, toxicity
from .common import held_out, table

TOKENIZER = "word_bpe_49k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the hosts and paths of the pages that show a document; where no page does, its source and language
    stand for them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    sites = quality_classifier.page_sites(table(spark, sf_dir, "pages"))
    return quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")), sites=sites)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs), keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_pairs(table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs, keep_text=False))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % topk_search.EVERY == 0)


def op13_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.summary(*elkan.clustered(table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (op1_toxicity, op2_quality_classifier, op3_language_id, op4_embedding_dedup, op5_mixing, op6_simhash, op7_bpe, op8_license_scan, op9_quality_rules, op10_chat_format, op11_periodic_runs, op12_exact_topk, op13_elkan_clusters, pipeline)


def queries() -> dict:
    return {f.__name__: query(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    found = {"op5_mixing": mixing.ORACLE_SQL, "op8_license_scan": licenses.ORACLE_SQL, "op10_chat_format": chat_format.ORACLE_SQL, "op12_exact_topk": topk_search.ORACLE_SQL, "op13_elkan_clusters": elkan.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in found.items() if v}
