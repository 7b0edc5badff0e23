"""What the driver holds of a job: few and small plans, and memory given back."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, mixing, ngram_join, quality
from tidemark.llm.tables import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture
def labels_written(monkeypatch):
    """The labels of the tables that finding components writes, as they are written."""
    found = []

    def noted(frame, label, rows=0, written=components.written):
        found.append(label)
        return written(frame, label, rows)

    monkeypatch.setattr(components, "written", noted)
    return found


def test_links_that_one_task_reads_are_joined_at_once(spark, labels_written):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").coalesce(1)
    assert {tuple(r) for r in components.components(links).collect()} == {(i, 0) for i in range(301)}
    assert len(labels_written) == 1


def test_stars_need_no_further_round(spark, labels_written):
    links = spark.createDataFrame([(i, i // 50 * 50) for i in range(1000)], "a long, b long").repartition(7)
    assert {tuple(r) for r in components.components(links).collect()} == {(i, i // 50 * 50) for i in range(1000)}
    assert len(labels_written) == 1


@pytest.mark.parametrize("kind, coded", [("long", lambda i: i - 100), ("binary", lambda i: bytes([i * 37 % 256, i // 256, i % 256]))])
@pytest.mark.parametrize("most", [3, 200_000])
def test_random_links_over_many_tasks(spark, monkeypatch, kind, coded, most):
    monkeypatch.setattr(components, "LINKS", most)
    draw = random.Random(6)
    pairs = [(coded(draw.randrange(300)), coded(draw.randrange(300))) for _ in range(220)]
    group = {}
    for a, b in pairs:
        if a != b:
            both = group.get(a, {a}) | group.get(b, {b})
            group.update(dict.fromkeys(both, both))
    links = spark.createDataFrame(pairs, f"a {kind}, b {kind}").repartition(9)
    found = [(r["node"], r["component"]) for r in components.components(links).collect()]
    assert sorted(found) == sorted((node, min(both)) for node, both in group.items())


def test_no_links(spark):
    assert not components.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect()


def test_plans_of_stages_do_not_hold_the_operator_several_times(spark):
    docs = documents(spark, SF)
    read = " ".join(ngram_join.one_of_each(docs, 5, 80).inputFiles() + mixing.repeated(docs).inputFiles())
    assert "ngram-kept" in read and "ngram-profiles" not in read
    assert "mixing-choice" in read and "mixing-sizes" not in read


def test_fit_gives_the_drivers_memory_back_and_minds_no_order(spark, monkeypatch):
    docs, calls = documents(spark, SF).cache(), []
    ratings = quality.ratings_of(documents(spark, SF, "labels"))
    monkeypatch.setattr(quality.blocks, "give_back", lambda: calls.append(1))
    one = quality.fit(docs, ratings, 3)
    assert calls
    two = quality.fit(docs.repartition(9).sortWithinPartitions(F.desc("doc_id")), ratings, 3)
    assert (one.places == two.places).all() and (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()
