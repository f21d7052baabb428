"""The stages of the corpus pipeline on odd, repeated and empty rows, and on whole tables."""

import re

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from annolith.llm import jaccard, mixing, storage

D = "/root/testdata/sf0.001"
STAGES = dict(cp.STAGES)
#: Columns whose names the stages and operators use inside.
CLASHING = "score _score _text lang_pred Score _nth nth row _row keep _keep h _h h2 times rows here _here copy _copy size n label component digest key sid taken rank".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def odd(docs):
    """Twenty texts; of some, rows without id, repeated rows, an id with two texts; nulls, blanks, a long text, many columns."""
    df = docs.where("length(text) between 400 and 1500").orderBy("doc_id").limit(20)
    first = df.limit(3)
    long = df.orderBy(F.desc("doc_id")).limit(1).withColumns({"doc_id": F.lit(10**6), "text": F.repeat("text", 300)})
    null = lambda c: F.lit(None).cast(df.schema[c].dataType)
    df = df.unionByName(first).unionByName(first.withColumn("doc_id", null("doc_id"))).unionByName(long)
    df = df.unionByName(first.withColumns({"doc_id": F.lit(77), "source": null("source"), "lang": null("lang"), "n_chars": null("n_chars")}))
    df = df.unionByName(first.withColumn("text", null("text"))).unionByName(first.withColumn("text", F.lit(" \n")))
    for k, c in enumerate(CLASHING):
        if c.lower() not in {x.lower() for x in df.columns}:
            df = df.withColumn(c, F.lit(k))
    return storage.materialize(df, "odd")


def rows(df):
    return sorted(str(r) for r in df.collect())


def test_names_and_columns(spark, odd):
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_copies", "mix", "pack"]
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, odd, D)
        assert got.columns == odd.columns and got.dtypes == odd.dtypes, name
        got = storage.materialize(got, "t")
        assert set(rows(got)) <= set(rows(odd)), name
        assert rows(storage.materialize(stage(spark, odd.repartition(5), D), "t")) == rows(got), name
    assert "doc_id" in cp.packed(spark, odd, D).columns


def test_empty_tables(spark, odd):
    for name, stage in cp.STAGES:
        assert stage(spark, odd.where("false"), D).count() == 0, name


def test_quality_stage_goes_by_score(spark, docs):
    from annolith.llm import quality

    model = quality.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model, ["doc_id"]).where(F.col("score") >= quality.THRESHOLD).collect()}
    assert {r.doc_id for r in cp.good_quality(spark, docs, D).collect()} == good and 0 < len(good) < docs.count()


def test_language_stage_drops_texts_of_no_language(spark, docs, odd):
    kept = cp.known_language(spark, odd, D)
    assert kept.where("text is null or trim(text) = ''").count() == 0
    assert cp.known_language(spark, docs, D).count() > 0.9 * docs.where("lang is not null").count()


def test_one_of_each_class_stays(spark, docs):
    kept = [r.doc_id for r in cp.without_copies(spark, docs, D).collect()]
    classes = jaccard.classes(docs).collect()
    assert len(kept) == len(set(kept)) and set(kept) == {r.doc_id for r in classes if r.doc_id == r.component_id}


def test_rows_that_repeat_an_id(spark):
    """An id with two texts, of which one is a copy of another document: no class loses its only row, in any order of rows."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    data = [(2, a), (5, b), (5, a + " end")]
    for order in (data, data[::-1], [data[1], data[0], data[2]]):
        got = jaccard.keep_one(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted((r.doc_id, r.text) for r in got) == [(2, a), (5, b)]


def test_mix_repeats_whole_documents(spark, odd):
    taken = mixing.mix(odd).documents.where("size > 0").groupBy("h").agg(F.sum(F.round(F.col("taken") / F.col("size"))).alias("times"))
    got = cp.mixed(spark, odd, D).withColumn("hh", F.xxhash64(F.lit(17), "doc_id", "text")).groupBy("hh").count()
    assert {r["h"]: int(r["times"]) for r in taken.collect() if r["times"]} == {r["hh"]: r["count"] for r in got.collect()}


def test_run(spark, docs):
    got = cp.run(spark, D).toPandas()
    ends = got.groupby("sequence_id").apply(lambda g: (g.offset + g.length).max(), include_groups=False)
    assert len(got) and ends.max() <= 4096 and got.groupby("sequence_id").length.sum().equals(ends)
    assert set(got.doc_id) <= {r.doc_id for r in docs.where("text is not null").select("doc_id").collect()}
    assert cp.ORACLE_SQL is None and re.search("Defined results", cp.__doc__)
