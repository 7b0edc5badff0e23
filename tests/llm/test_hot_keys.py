"""Counts of very frequent keys, and license notices against alignment at every place."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import zstandard

from tidemark.llm import blocks, licenses, ngram_join, repeats


def test_a_shingle_of_65536_documents_is_not_told_as_unique():
    for copies in (65_536, 65_537):
        text = zstandard.compress(b"one two three")
        bucket = pa.table({"_bucket": pa.array([0] * copies, pa.int32()), "doc_id": pa.array(range(copies), pa.int64()), "_z": pa.array([text] * copies, pa.binary())})
        asked = list(ngram_join._ask_frequency(3, 1)(bucket))
        answers = list(ngram_join._answer_frequency(0, [0], [blob for _, _, blob in asked]))
        (low, _, rank, _) = blocks.unpacked(answers[0][1], np.uint32, np.uint8, np.uint8, np.int64)
        assert len(low) == 1 and rank[0] > 1


def test_counts_of_anchors_in_seven_bits():
    counts = np.array([1, 2, 63, 64, 65, 127, 4_000, 32_000, 10**6, 10**9])
    told = repeats._small(counts)
    back = repeats._COUNTS[told]
    assert told.max() < 128 and (back <= counts).all() and (np.diff(told) >= 0).all()
    assert (back[:4] == counts[:4]).all() and (back[:-1] > counts[:-1] * 0.8).all()


def test_no_notice_is_missed():
    draw = random.Random(8)
    names = ["MIT notice", *[n for n in licenses.TEMPLATES if len(licenses.TEMPLATES[n].split()) < 60]][:5]
    templates = {n: licenses.TEMPLATES[n] for n in names if n in licenses.TEMPLATES}
    pool = sorted({w for t in templates.values() for w in t.split()}) + ["lorem", "ipsum", "the", "of"]
    texts = []
    for i in range(24):
        words = draw.choices(pool, k=draw.randint(0, 50))
        for _ in range(i % 3):
            notice = draw.choice(list(templates.values())).split()
            for _ in range(draw.randint(0, max(1, len(notice) // 4))):
                at = draw.randrange(len(notice))
                notice[at : at + 1] = draw.choice([[], ["changed"], [notice[at], "added"]])
            at = draw.randint(0, len(words))
            words[at:at] = notice
        texts.append(" ".join(words))
    texts += [None, "", "MIT", "the the the the the"]

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, scan, _):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
            return [r for found in scan(iter([batch])) for r in found.to_pylist()]

    best: dict[tuple[int, str], int] = {}
    for r in licenses.scanned(Frame(), templates):
        key = (r["doc_id"], r["license"])
        best[key] = max(best.get(key, 0), r["matched_words"])
        assert texts[r["doc_id"]][r["start_char"] : r["end_char"]] == r["passage"]
    index, expected = licenses.Index(templates), {}
    for number, text in enumerate(texts):
        hashes = licenses._words(*blocks.flat(pa.array([text], pa.string())))[3]
        for name, words in zip(index.names, index.words, strict=True):
            most = max((licenses.aligned(words, hashes, at)[0] for at in range(-licenses.BAND, len(hashes) + 1)), default=0)
            if most and most >= licenses.LEAST_COVERAGE * len(words):
                expected[number, name] = most
    assert set(best) == set(expected) and expected
    assert all(best[k] >= expected[k] - licenses.BAND for k in expected)
