"""A passage that many buckets hold goes to its shards once, not once from each."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import exchange, fm_index, repeats, suffixes


@pytest.mark.parametrize("by_word", [False, True])
def test_copies_of_a_passage_send_its_text_once(spark, monkeypatch, by_word):
    draw = random.Random(7)
    passage = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(1500))
    rows = [(i, f"{draw.random()} {passage} {draw.random()}") for i in range(40)]
    asked, ask_again = [], exchange.ask_again
    monkeypatch.setattr(exchange, "ask_again", lambda *some: asked.append(ask_again(*some)) or asked[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    find, plain = (fm_index, brute.substring_dedup) if by_word else (suffixes, brute.suffix_dedup)
    found = {r["doc_id"]: r["n_removed"] for r in find.deduplicated(docs, with_kept=False).collect()}
    assert found == {r[0]: r[2] for r in plain(rows)} and max(found.values()) > 1400
    sent = sum(frame.agg(F.sum(F.length("_blob"))).first()[0] for frame in asked)
    buckets = exchange.bucketed(docs).select("_bucket").distinct().count()
    # One copy in overlapping stretches, and hashes from each bucket; texts from each would be over this.
    assert buckets > 3 and sent < 1.5 * buckets * len(passage)


def test_runs_do_not_depend_on_what_lies_before_a_document():
    search, text = repeats.Search(50, 16, by_word=False, earlier=True), b"ab" * 200 + b"the end of it"
    alone = repeats.runs(search, search.texts(pa.array([text], pa.large_binary())))
    for n in (1, 17, 63, 100):
        there = search.texts(pa.array([b"x" * n, text], pa.large_binary()))
        found = repeats.runs(search, there)
        mine = found.first >= n
        assert np.array_equal(found.first[mine] - n, alone.first) and np.array_equal(found.last[mine] - n, alone.last)
