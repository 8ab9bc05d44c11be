"""Every stage of the pipeline on odd, clashing and empty tables, and on one very long text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.llm import toxicity

FILTERS = corpus_pipeline.STAGES[:-1]


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark, labels):
    path = tmp_path_factory.mktemp("tables")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name,stage", FILTERS, ids=[n for n, _ in FILTERS])
def test_stage_keeps_columns(spark, odd, clashing, none, tables, name, stage):
    """Odd rows pass or go without an error, extra columns stay whatever their names, and nothing gives nothing."""
    dotted = clashing.withColumn("a.b", F.lit(7)).withColumn("toxicity", F.lit("x"))
    got = stage(spark, dotted, tables)
    assert got.columns == dotted.columns and 0 < got.count() <= odd.count()
    assert {(r["a.b"], r["toxicity"], r["rank"]) for r in got.collect()} == {(7, "x", 3)}
    empty = stage(spark, none, tables)
    assert empty.columns == none.columns and empty.count() == 0


def test_last_stage(spark, odd, none, tables):
    stage = corpus_pipeline.STAGES[-1][1]
    assert {r["doc_id"] for r in stage(spark, odd.withColumn("a.b", F.lit(1)), tables).collect()} == {r["doc_id"] for r in odd.collect()}
    assert stage(spark, none, tables).count() == 0


def test_a_very_long_text_passes_all_stages(spark, tables):
    """6 MB of different words, beside short texts: it stays, whole."""
    long = "\n".join(" ".join(f"w{i * 12 + k}" for k in range(12)) for i in range(60_000))
    rows = [(1, long, "en", "a", len(long)), *((i, f"A short text number {i} with some own words like x{i} y{i} z{i}.", "en", "b", 60) for i in range(2, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in FILTERS[:3]:
        docs = stage(spark, docs, tables)
        assert docs.where("doc_id = 1").first()["text"] == long, name


def test_scores_do_not_change_by_further_columns(spark, odd, labels):
    machine = toxicity.fit(odd, labels)
    plain = sorted(str(r["score"]) for r in toxicity.with_score(odd, machine).collect())
    assert plain == sorted(str(r["score"]) for r in toxicity.with_score(odd.withColumn("x.y", F.lit(1)), machine).collect())
