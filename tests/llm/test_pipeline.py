"""The five stages, each against its own input by brute force, and the registered queries."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests import sidebyside
from tests.llm import brute
from tidemark.llm import mixing, quality, queries
from tidemark.llm.tables import documents, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of every stage."""
    docs, out = documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_stages_keep_the_columns_of_documents(spark, stages):
    columns = documents(spark, SF).columns
    assert all(after.columns == columns for _, after in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "source_mix", "packing"]


def test_quality_stage_keeps_what_the_model_keeps(spark, stages):
    docs, after = stages[0]
    model = quality.fit(docs, quality.ratings_of(documents(spark, SF, "labels")), 3)
    table = docs.select("doc_id", "text").toArrow().combine_chunks()
    keep = model.tails(table.column("text").chunk(0))[:, -1] >= 0.5
    assert sorted(d for d, _ in texts(after)) == sorted(d for d, k in zip(table.column("doc_id").to_pylist(), keep, strict=True) if k)


def test_near_copy_stage_keeps_the_least_of_each_group(stages):
    docs, after = stages[1]
    assert sorted(d for d, _ in texts(after)) == sorted(d for d, _, c in brute.components(texts(docs), 5, 80) if d == c)


def test_passage_stage_cuts_what_repeats(stages):
    docs, after = stages[2]
    gone = {d: (n, removed) for d, n, removed, _ in brute.substring_dedup(texts(docs))}
    kept, before = dict(texts(after)), dict(texts(docs))
    assert set(kept) == {d for d, (n, removed) in gone.items() if removed == 0 or removed < n}
    for d, text in kept.items():
        n, removed = gone[d]
        assert len(brute.words(text)) == n - removed
        assert removed or text == before[d]
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_mixing_stage_takes_what_the_mix_says(stages):
    docs, after = stages[3]
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["taken"]}
    found: dict = {}
    for d, _ in texts(after):
        found[d] = found.get(d, 0) + 1
    assert found == times


def test_packing_stage_holds_every_id_once(stages):
    docs, after = stages[4]
    n = after.selectExpr("sum(length)").first()[0]
    assert n == sum(r["doc_tokens"] for r in after.where("start = 0").collect())
    assert after.where("start = 0").count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert sidebyside.difference(queries.queries()[name](spark, SF), SF, queries.oracle_sql()[name]) is None


def test_there_is_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.queries()) == list(range(1, 14))


CLASHING = ["_size", "_copies", "_rows", "_nth", "_times", "_time", "_bucket", "_z", "_text", "_shard", "_blob", "size", "key", "column0"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, blanks, repeated ids and a long text, beside columns with names that stages use inside."""
    passage = " ".join(f"w{i * i % 91}x{i}" for i in range(60))
    rows = [
        (1, "plain words that stand here once", "en", "s1"), (2, None, "en", "s1"), (3, "", "en", None), (4, " \t\n", None, "s2"), (5, passage, "en", "s2"),
        (6, "before " + passage + " after", "en", "s2"), (7, passage + " end", "en", "s3"), (7, "another text under one id", "en", "s3"),
        (8, "twice the same row", "en", "s3"), (8, "twice the same row", "en", "s3"), (None, "no id here", "en", "s1"), (None, "no id here", "en", "s1"),
        (9, " ".join(f"long{i}" for i in range(30_000)), "en", "s1"),
    ]
    frame = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for i, name in enumerate(CLASHING):
        frame = frame.withColumn(name, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return frame.repartition(3)


@pytest.mark.parametrize("number", range(4))
def test_stages_carry_columns_whatever_their_names(spark, awkward, number):
    name, stage = corpus_pipeline.STAGES[number]
    after = written(stage(spark, awkward, SF), f"awkward-{name}")
    assert after.columns == awkward.columns
    rows = after.collect()
    assert rows
    for row in rows:
        assert [row[c] for c in CLASHING] == [f"{i}:{'none' if row['doc_id'] is None else row['doc_id']}" for i in range(len(CLASHING))]


def test_near_copy_stage_keeps_rows_without_id_or_words(spark, awkward):
    kept = [r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, awkward, SF).select("doc_id").collect()]
    # 5, 6 and 7 share their passage; the other text under id 7 goes by the id it shares.
    expected = {d for d, _, c in brute.components(texts(awkward), 5, 80) if d is not None and d == c}
    assert sorted(d for d in kept if d is not None) == sorted(expected)
    assert kept.count(None) == 2


def test_passage_stage_on_awkward_rows(spark, awkward):
    after = corpus_pipeline.without_repeated_passages(spark, awkward, SF).select("doc_id", "text", "n_chars").collect()
    found = {r["doc_id"]: r["text"] for r in after}
    assert 5 not in found and found[6] == "before after" and found[2] == "" and found[4] == " \t\n"
    assert len(found[9].split()) == 30_000
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_mixing_stage_on_awkward_rows(spark, awkward):
    after = corpus_pipeline.mixed_sources(spark, awkward, SF).select("doc_id", "text").collect()
    assert not {2, 3, 4} & {r["doc_id"] for r in after}
    taken = sum(r["taken"] for r in mixing.mix(awkward).collect())
    assert sum(len(brute.words(r["text"])) for r in after) == taken


@pytest.mark.parametrize("number", range(5))
def test_stages_of_an_empty_table(spark, awkward, number):
    name, stage = corpus_pipeline.STAGES[number]
    assert written(stage(spark, awkward.where("false"), SF), f"empty-{name}").count() == 0
