"""Texts that were made to have the same hash are still different texts."""

from __future__ import annotations

from tests.llm import brute
from tests.llm.test_operators import SCHEMA, collected, ordered
from tidemark.llm import fm_index, ngram_join, suffixes

#: Equal under powers of one known factor and one known table of byte values.
ONE, TWO = "dpjpznrnlwbucpkugggrtbfpzlyehsdw", "qnpcntgnsbeyvqsdlqmcchhlzivdfxfw"
WORDS = " ".join(f"w{i}" for i in range(40))


def doubling(times: int) -> str:
    """A word and its mirror image are equal under powers of any factor, modulo a power of two."""
    word = "a"
    for _ in range(times):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def frame(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts, 1)]
    return rows, spark.createDataFrame([(d, t, "en", None, len(t)) for d, t in rows], SCHEMA)


def test_words_with_equal_powers(spark):
    long = doubling(11)
    mirrored = long.translate(str.maketrans("ab", "ba"))
    rows, docs = frame(spark, [f"{ONE} {WORDS[:-12]}", f"{TWO} {WORDS[:-12]}", f"{long} {WORDS[3:]}", f"{mirrored} {WORDS[3:]}", f"x {long}", f"x {mirrored}"])
    assert collected(fm_index.deduplicated(docs, with_kept=False).drop("kept")) == ordered(brute.substring_dedup(rows))
    assert collected(ngram_join.joined(docs)) == ordered(brute.components(rows))


def test_bytes_with_equal_powers(spark):
    tail = "xxsutwxnvxhbealagg"
    rows, docs = frame(spark, [ONE + tail, TWO + tail, TWO + tail + "x"])
    assert collected(suffixes.deduplicated(docs, with_kept=False).drop("kept")) == ordered(brute.suffix_dedup(rows))
