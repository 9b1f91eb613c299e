"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mercadia.llm import (
    binary_records,
    licenses,
    near_duplicates,
    packing,
    positional_index,
    quality_rules,
    sharding,
    site_quality,
    toxicity,
    url_rules,
)
from mercadia.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, k1 long"
GOOD = "The cat sat on the mat and looked at the small dog that was in the garden of the house by the river. It was a day for all."
LONG = " ".join(f"word{k} of the" for k in range(15_000))


def rows():
    return [
        (1, GOOD, "en", "a", 1, True, "x", 1),
        (1, GOOD, "en", "a", 1, True, "x", 1),
        (2, GOOD, None, None, None, None, None, None),
        (None, "Another text with a null id that is long enough to be a document of the test for the rules.", "en", "a", 1, True, "x", 1),
        (3, None, "en", "a", 0, False, "y", 2),
        (4, "", "en", None, 0, False, "y", 2),
        (5, " \n\t ", "en", "b", 0, False, "y", 2),
        (6, LONG, "en", "b", 0, False, "y", 2),
        (6, "The same id with a text of its own, which is not like the other and has some words of the language in it.", "en", "b", 0, False, "y", 2),
    ]


@pytest.fixture(params=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame(rows() if request.param == "rows" else [], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (None, None, None), (99, None, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(7, GOOD), (8, None), (9, ""), (None, "text of its own"), (7, GOOD)], "item_id long, text string")


def count(docs) -> int:
    return docs.count()


def test_near_duplicates(docs):
    found = near_duplicates.duplicate_classes(docs)
    assert found.count() == count(docs)
    for row in found.collect():
        if row.doc_id in (1, 2):
            assert (row.class_id, row.class_size) == (1, 3)
        else:
            assert row.class_size == 1 and row.class_id == row.doc_id


def test_one_of_each_keeps_columns_and_wordless_rows(docs):
    kept = near_duplicates.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id or 0) for r in kept.collect())
    assert ids == ([0, 1, 3, 4, 5, 6, 6] if count(docs) else [])


def test_sharding(docs):
    placed = sharding.place(docs, ["a", "b", "c"], slots=101)
    assert placed.count() == count(docs) and placed.filter("shard is null").count() == 0
    same = {(r["row"].doc_id, r.shard) for r in placed.collect() if r["row"].doc_id == 1}
    assert len(same) <= 1


def test_toxicity(docs, labels):
    for known in (labels, labels.limit(0)):
        found = toxicity.toxicity_report(docs, known).collect()
        assert len(found) == count(docs) and all(0 <= r.score <= 1 for r in found)


def test_urls(spark):
    schema = "page_id long, url string, html string, verdict string"
    urls = [(1, None, "<p>"), (1, None, None), (None, "no scheme", ""), (2, "http://x.net", ""), (3, "HTTP://A.Example.NET/en/1?x#y", None), (4, "://", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in urls], schema)
    found = url_rules.verdicts(pages, url_rules.rule_table(pages, url_rules.RULES)).collect()
    assert sorted((r.host, r.path, r.rule, r.verdict) for r in found if r.rule) == [("a.example.net", "/en/1", "example.net/en/", "allow")]
    assert len(found) == 6 and {r.verdict for r in found} == {"allow"}
    assert url_rules.verdicts(pages.limit(0), url_rules.rule_table(pages, url_rules.RULES)).count() == 0


def test_records(docs):
    _, index = binary_records.encode_to_records(docs, tokenizer_file(), end_id=2)
    found = index.orderBy("start").collect()
    assert len(found) == count(docs)
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:k]) for k in range(len(found))]
    assert [r.doc_id for r in found] == ([None, 1, 1, 2, 3, 4, 5, 6, 6] if found else [])


def test_quality_rules(docs):
    found = quality_rules.quality_report(docs).collect()
    assert len(found) == count(docs)
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in found if r.doc_id in (3, 4, 5))
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and all(r.text for r in kept.collect())


def test_licences(docs):
    found = licenses.licence_report(docs).collect()
    assert len(found) == count(docs) and all(r.licences == [] for r in found)


def test_packing(docs):
    pieces = packing.packed(docs, tokenizer_file(), separator_id=0).collect()
    total = sum(r.length for r in pieces)
    assert total == sum({(r.doc_id, r.doc_tokens): r.doc_tokens * (2 if r.doc_id == 1 else 1) for r in pieces}.values())


def test_decontamination(docs, benchmark):
    report = positional_index.contamination(docs, benchmark)
    found = report.collect()
    assert len(found) == count(docs)
    for row in found:
        if row.doc_id in (1, 2):
            assert row["items"] == ["7"] and row.n_hit == row.n_words
        elif row.doc_id == 6 and row.n_words < 100:
            assert row["items"] == [] and row.n_hit == 4
        else:
            assert row.n_hit == 0
    clean = positional_index.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == (5 if found else 0)
    assert positional_index.contamination(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_site_quality(docs, labels):
    for known in (labels, labels.limit(0)):
        found = site_quality.quality_scores(docs, known).collect()
        assert len(found) == count(docs) and all(0 <= r.score <= 1 for r in found)
    assert site_quality.kept_documents(docs, labels.limit(0)).columns == docs.columns


def test_pipeline_over_edges(spark, tmp_path, docs, labels, benchmark):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.limit(0).write.parquet(f"{folder}/benchmark.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.columns == docs.columns, name
        path = f"{folder}/{name.replace(' ', '-')}"
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
    assert corpus_pipeline.STAGES[-1][1](spark, frame, folder).filter(F.col("length") < 1).count() == 0
