"""What a bucket and a shard's index take at once, whatever the length of their texts."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import zstandard

from tidemark.llm import blocks, fm_index, repeats


def peak(work) -> float:
    """Megabytes."""
    blocks.give_back()
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def text(draw: random.Random, n: int) -> str:
    return " ".join(draw.choices([f"w{i}" for i in range(3000)], k=n))


def test_words_are_hashed_by_stretches():
    data = np.frombuffer(text(random.Random(1), 600_000).encode(), np.uint8)
    starts, ends, _ = blocks.words(data, np.array([0, len(data)]))
    found = []
    assert peak(lambda: found.append(blocks.word_hashes(data, starts, ends, fold=False, seed=9))) < 40
    assert (found[0] == blocks.Rolling(blocks.byte_values(9)[data], 9).of(starts, ends)).all()


def test_a_bucket_is_asked_about_in_small_blocks():
    draw, press = random.Random(2), zstandard.ZstdCompressor(level=1)
    packed = [press.compress(text(draw, 4000).encode()) for _ in range(200)]
    bucket = pa.table({"_bucket": pa.array([0] * 200, pa.int32()), "doc_id": pa.array(range(200), pa.int64()), "_z": pa.array(packed, pa.binary())})
    question = repeats._ask_anchors(fm_index._search(35, 8)[0], 4)
    assert peak(lambda: list(question(bucket))) < 100


def test_words_of_a_shard_take_little_beside_its_index():
    draw = random.Random(3)
    pieces = [" ".join(f"{draw.randrange(50_000):060d}" for _ in range(60)).encode() for _ in range(1000)]
    data, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
    assert peak(lambda: fm_index.repeated_windows(data, sizes, np.ones(1000, np.int64), 35, 7)) < 12 * len(data) / 1e6
