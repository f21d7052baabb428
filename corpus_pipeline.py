"""A training corpus from ``documents``: judge, identify, remove near copies, mix, pack.

Every stage takes what its predecessor kept. All but the last return the columns of documents:

1. quality    documents of good quality stay (generalised additive model)
2. language   documents of a known language stay (conditional random field)
3. near copies  one document of each class of similar ones stays (n-gram Jaccard join)
4. mix        documents as often as the mix of sources takes them, zero to two times
5. pack       the pieces of all documents in sequences of 4096 tokens

Defined results
  null or empty text   no words: rejected by the language stage, if not before
  null or repeated id  each row is judged by itself; copies go by text, and rows that agree in id and text are
                       copies, of which that whose columns' hash is smallest stays
  ties                 settled by id, then by hash, so reruns agree
  empty table          no rows
  more columns         are carried to the last stage but one, whatever their names
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.llm import jaccard, langid, mixing, packing, quality, storage, words

SCOPE = "pipeline"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score reaches the classifier's threshold."""
    with storage.scope(spark, SCOPE):
        model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        (score,) = words.unused(docs.columns, "score")
        return quality.score(docs, model, docs.columns, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that are of one of the learned languages, by half of their words' probability at least."""
    with storage.scope(spark, SCOPE):
        lang, score = words.unused(docs.columns, "lang_pred", "score")
        labelled = langid.predict(docs, langid.train(docs), docs.columns, (lang, score))
        return labelled.where((F.col(lang) != "und") & (F.col(score) >= langid.LEAST)).drop(lang, score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar documents."""
    with storage.scope(spark, SCOPE):
        return jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix takes them."""
    with storage.scope(spark, SCOPE):
        return mixing.repeat_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    with storage.scope(spark, SCOPE):
        return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("language", known_language), ("near_copies", without_copies), ("mix", mixed), ("pack", packed)]

#: The stages learn models and run a graph search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
