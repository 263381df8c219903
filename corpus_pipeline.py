"""A corpus pipeline of five operators.  Each stage works on all that the one before kept; all but the last return the
columns of ``documents``.

Rows: an empty table of documents gives an empty result.  A null or empty text has no words, so the quality rules let it go.
Repeated rows share their fingerprint, so one of them stays; how often it comes then is the mix's choice.  A null source is a
source of its own.  Further columns pass through all stages but the last; those named like an operator's results keep
their values.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemo.llm import bpe, mixing, quality_rules, simhash, toxicity
from mnemo.llm.common import checkpoint_folder, cut, table
from mnemo.session import ready

TOKENIZER = "word_bpe_49k.json"


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learned from the labelled ones among them that are not held out."""
    ready(spark)
    return toxicity.filtered(docs, table(spark, sf_dir, "labels"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    ready(spark)
    return quality_rules.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    ready(spark)
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    ready(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, source, token ids and the text that they decode to, of each document of the mix."""
    ready(spark)
    coded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), outputs=("token_ids", "n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)
    return coded.select("doc_id", "lang", "source", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality_rules", quality_filter),
    ("simhash_dedup", near_dedup),
    ("mixing", mix),
    ("bpe", encode),
]

#: The stages learn, traverse and merge; SQL cannot state their rows.  Tests hold them against a brute-force version.
ORACLE_SQL = None


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.  A stage's table goes when
    the next one is written, and all of them before this returns, also when a stage fails: the result reads a checkpoint,
    which Spark keeps as long as something refers to it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (name, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove(spark, folder)
