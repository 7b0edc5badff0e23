"""The registered byte query against its SQL where ids are missing and texts are empty."""

from __future__ import annotations

import duckdb
import numpy as np

from tests.llm import brute
from tests.llm.test_operators import SCHEMA, collected, ordered
from tidemark.llm import blocks, fm_index, queries, suffixes

BASE = "".join(chr(97 + i * i % 23) for i in range(180)) + "é漢😀" * 20


def rows():
    texts = [BASE, BASE, BASE[20:], None, "", "\x00" * 70, "\x00" * 90, "ab" * 200, BASE + "ab" * 60, "x" + BASE, "  ", "z" * 49, "z" * 50, "z" * 51]
    return list(zip([5, None, None, 1, 2, -3, 9, 1 << 40, -(1 << 63), 11, 12, 13, 14, None], texts, strict=True))


def test_rows_without_id_lose_nothing_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame([(d, t, "en", None, None) for d, t in rows()], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        expected = con.execute(queries.OP10_SQL).fetchall()
    assert collected(queries.op10_suffix_dedup(spark, str(tmp_path))) == ordered(expected)


def test_a_bucket_of_empty_texts(spark):
    # Every row is a bucket of its own.
    some = [(i, t) for i, t in enumerate([None, "", BASE, "", BASE, None])]
    frame = spark.createDataFrame([(d, t, "en", None, None) for d, t in some], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert collected(suffixes.deduplicated(frame, with_kept=False).drop("kept")) == ordered(brute.suffix_dedup(some))
        assert collected(fm_index.deduplicated(frame, with_kept=False).drop("kept")) == ordered(brute.substring_dedup(some))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_hashes_of_nothing():
    blocks.give_back()
    assert len(blocks.Rolling(np.zeros(0, np.uint64), 3).windows(8)) == 0
