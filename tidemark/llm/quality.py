"""Quality by ordinal regression: one hashed-text score, ordered thresholds between grades.

The model is a cumulative-link (proportional odds) regression.  A text has one
score, the sum of the weights of its hashed features; ordered thresholds cut the
line of scores into grades, so that P(grade <= j) = sigmoid(threshold_j - score).
It is fitted by stochastic gradients on a bounded sample of rated rows and then
read by every task.  All rows are scored, over their whole texts.

Rows: a null or blank text has only its shape features; ratings without a row in
``docs`` or without a grade are ignored; of several ratings of a document the
lowest counts, of several rows with one id one text is used for fitting.  With
no usable rating every row gets the highest grade.  Repeated rows are scored one
by one, columns beyond ``doc_id`` and ``text`` are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import blocks

#: At most so many rated documents are used for fitting, the first by a seeded hash.
SAMPLE_ROWS = 12_000
DIMENSIONS = 1 << 18
_SHAPES = 64
#: Bytes of text looked at in one piece: features take some thirty times as much.
BLOCK = 1 << 20


def _shape(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Binned proportions of every text, as feature numbers: one per kind and text."""
    n_texts, n_words = len(offsets) - 1, np.diff(first)
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    kinds = np.zeros(256, np.uint8)
    kinds[65:91], kinds[48:58] = 1, 2
    kinds[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
    kind = kinds[data]
    doc = np.repeat(np.arange(n_texts), n_words)
    ordered = np.lexsort((hashes, doc))
    new = np.ones(len(hashes), bool)
    if len(hashes):
        new[1:] = (np.diff(doc[ordered]) != 0) | (hashes[ordered][1:] != hashes[ordered][:-1])
    distinct = np.bincount(doc[ordered][new], minlength=n_texts) / np.maximum(n_words, 1)
    echo = np.zeros(len(hashes), bool)
    if len(hashes):
        echo[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    echoes = np.bincount(doc[echo], minlength=n_texts) / np.maximum(n_words, 1)
    measures = [
        np.sqrt(share(kind == 1)), np.sqrt(share(kind == 2)), np.sqrt(share(kind == 3)),
        distinct, np.sqrt(echoes), np.minimum(np.log2(n_words + 1) / 20, 1), np.minimum(size / np.maximum(n_words, 1) / 40, 1),
    ]
    bins = np.stack([np.minimum((m * 32).astype(np.int64), _SHAPES - 1) + i * _SHAPES for i, m in enumerate(measures)])
    return blocks.mixed((bins.T + 1_000_003).astype(np.uint64)) & np.uint64(DIMENSIONS - 1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) for every word, word beginning and word ending, and the
    shape features by text."""
    data, offsets = blocks.flat(texts)
    starts, ends, first = blocks.words(data, offsets)
    folded = blocks.word_hashes(data, starts, ends, fold=True)
    endings = blocks.word_hashes(data, np.maximum(ends - 2, starts), ends, fold=False)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    beginnings = blocks.word_hashes(data, starts, np.minimum(starts + 6, ends), fold=True)
    mask = np.uint64(DIMENSIONS - 1)
    kinds = (folded, endings + np.uint64(7), beginnings + np.uint64(8))
    both = np.concatenate([blocks.mixed(k) & mask for k in kinds]).astype(np.int64)
    return np.concatenate((doc, doc, doc)), both, _shape(data, offsets, first, folded).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Sparse weights and the ordered thresholds; grades count from 0."""

    places: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= j) for j = 1 .. highest, one row per text."""
        dense = np.zeros(DIMENSIONS)
        dense[self.places] = self.weights
        doc, word, shape = features(texts)
        score = dense[shape].sum(axis=1)
        live = dense[word] != 0
        # A feature counts once per text, however often it occurs.
        once = np.unique(doc[live] * DIMENSIONS + word[live])
        score += np.bincount(once // DIMENSIONS, dense[once % DIMENSIONS], minlength=len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fitted(
    places: np.ndarray, ends: np.ndarray, grades: np.ndarray, n_grades: int, seed: int,
    epochs: int = 8, rate: float = 0.1, shrink: float = 2e-3,
) -> Model:
    """Proximal AdaGrad on the negative log-likelihood of the grades.

    The features of row i are ``places[ends[i]:ends[i + 1]]``.
    """
    weights, history = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-3)
    thresholds, moved = np.linspace(-1.0, 1.0, n_grades - 1), np.full(n_grades - 1, 1e-3)
    draw = np.random.default_rng(seed)
    for _ in range(epochs if len(grades) else 0):
        order = draw.permutation(len(grades))
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            sizes = ends[some + 1] - ends[some]
            flat, owner = places[blocks.spread(ends[some], sizes)], np.repeat(np.arange(len(some)), sizes)
            score, y = np.bincount(owner, weights[flat], minlength=len(some)), grades[some]
            upper = np.concatenate((thresholds, [np.inf]))[y] - score
            lower = np.concatenate(([-np.inf], thresholds))[y] - score
            up, low = 1 / (1 + np.exp(-np.clip(upper, -40, 40))), 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
            up, low = np.where(y == n_grades - 1, 1.0, up), np.where(y == 0, 0.0, low)
            slope = 1 - up - low  # of the loss by the score
            gradient = np.bincount(flat, (slope / len(some))[owner], minlength=DIMENSIONS)
            history += gradient**2
            step = rate / np.sqrt(history)
            weights -= step * gradient
            seen = np.unique(flat)
            weights[seen] = np.sign(weights[seen]) * np.maximum(np.abs(weights[seen]) - step[seen] * shrink, 0)
            chance = np.maximum(up - low, 1e-9)
            for j in range(n_grades - 1):
                g = (-(up * (1 - up) / chance)[y == j].sum() + (low * (1 - low) / chance)[y == j + 1].sum()) / len(some)
                moved[j] += g * g
                thresholds[j] -= rate * g / np.sqrt(moved[j])
            thresholds = np.maximum.accumulate(thresholds)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return Model(used, weights[used], thresholds)


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> Model:
    """A model from at most ``sample_rows`` of ``ratings`` (doc_id, grade 0 .. n_grades - 1)."""
    chosen = (
        ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("grade").cast("int").alias("grade"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(sample_rows)
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.cut(batches, most=BLOCK):
            doc, word, shape = features(block.column("text"))
            rows = block.num_rows
            pairs = np.unique(np.concatenate((doc, np.repeat(np.arange(rows), shape.shape[1]))) * DIMENSIONS + np.concatenate((word, shape.ravel())))
            ends = np.searchsorted(pairs // DIMENSIONS, np.arange(rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs % DIMENSIONS).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("grade"), lists], names=["doc_id", "grade", "features"])
        blocks.give_back()

    # The sample is at most sample_rows rows of two numbers, so its broadcast is bounded.
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = (
        rated.mapInArrow(read, "doc_id long, grade int, features array<int>")
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"), F.min("features").alias("features"))
        .toArrow()
    )
    if not found.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(n_grades - 1, -40.0))
    # One array of 32-bit numbers for all rows, laid by doc_id, and where each row ends.
    column, order = found.column("features"), np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    sizes, grades = pc.list_value_length(column).to_numpy(), found.column("grade").to_numpy().astype(np.int64)[order]
    ends = np.concatenate(([0], np.cumsum(sizes[order]))).astype(np.int64)
    begins, row = np.empty(len(order), np.int64), 0
    begins[order] = ends[:-1]
    places = np.empty(ends[-1], np.int32)
    for chunk in column.chunks:
        flat, at = chunk.flatten().to_numpy(), 0
        for begin, size in zip(begins[row : row + len(chunk)].tolist(), sizes[row : row + len(chunk)].tolist(), strict=True):
            places[begin : begin + size] = flat[at : at + size]
            at += size
        row += len(chunk)
    del found, column
    model = fitted(places, ends, grades, n_grades, seed)
    del places
    # The driver lives on for the stages that follow, as the workers do.
    blocks.give_back()
    return model


def graded(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail (P(grade >= 1), P(grade >= 2), ...), keep for every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.cut(batches, most=BLOCK):
            tails = model.tails(block.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(tails.sum(axis=1)),
                    pa.array(list(tails), pa.list_(pa.float64())),
                    pa.array(tails[:, -1] >= least),
                ],
                names=["doc_id", "expected_grade", "tail", "keep"],
            )

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, expected_grade double, tail array<double>, keep boolean")


def selected(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose chance of the highest grade is at least ``least``.

    Each row is judged by its whole text alone: repeated rows alike, a null or blank text as
    one without words.  An empty table gives an empty one; further columns are carried,
    whatever their names.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.cut(batches, most=BLOCK):
            keep = model.tails(block.column("text"))[:, -1] >= least
            yield block.filter(pa.array(keep))
        blocks.give_back()

    return docs.mapInArrow(pick, schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Three grades from the two flags: 0 toxic, 1 of low quality, 2 good."""
    return labels.select(
        "doc_id",
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"),
    )
