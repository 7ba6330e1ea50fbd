"""The pipeline against plain versions of its stages, and its registration."""

import inspect

import pytest

import __spark_entry__
import corpus_pipeline
from fieldlens.llm import exact_dedup, language_id, queries, quality_classifier
from tests import compare
from tests.llm.test_near import plain

FOLDER = "/root/testdata/sf0.001"


def test_eleven_queries():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and all(name in names for name in queries.QUERIES)


def test_stages_keep_whole_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.dtypes == docs.dtypes, name
        assert set(after.collect()) <= set(docs.collect()), name


def test_pipeline_equals_its_parts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_classifier.quality_scores(docs, labels).collect() if r.predicted}
    left = docs.where(docs.doc_id.isin(sorted(good)))
    known = {r.doc_id for r in language_id.languages(left).collect() if r.lang_pred != "und" and r.score >= language_id.MIN_SCORE}
    single = {r.doc_id for r in exact_dedup.exact_duplicates(docs.where(docs.doc_id.isin(sorted(known)))).collect() if r.kept}
    assert single <= known
    kept = {i for i, _, component, _ in plain([(i, texts[i]) for i in sorted(single)], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT) if i == component}
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == kept
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in places) <= 2048 for places in by_sequence.values())


def test_pipeline_over_nothing(spark, documents):
    empty = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    mine = queries.QUERIES[name](spark, FOLDER)
    assert mine.columns[0] == "doc_id"
    frame = mine.toPandas()
    if name != "op3_packing":
        assert len(frame) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    if name in queries.ORACLES:
        assert compare.difference(frame, compare.connect(FOLDER).sql(queries.ORACLES[name]).df()) is None


def test_native_operators_use_no_python(spark):
    for name in ("op1_license_scan", "op5_exact_dedup", "op8_sharding"):
        plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop")), name


def test_stage_functions_take_three_arguments():
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)
