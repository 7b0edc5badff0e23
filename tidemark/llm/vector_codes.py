"""Vectors as short codes: one codebook per part, searched by equal averages.

Components become integers, a vector is cut into equal parts, and each part is
written as the index of its codebook's nearest entry.  Codebooks are refined by
rounds of assignment and averaging in integer arithmetic, so results do not depend
on how Spark deals the rows.

The search sorts a codebook by component sum.  For a part with sum s and an entry
with sum t, the squared distance is at least (s - t)**2 / dimension; so the search
starts beside s, goes outward to both sides, and stops when the squared gap over
the dimension strictly exceeds the best distance.  What it leaves out cannot win
and cannot tie.

Rows: vectors that are null, or hold null or non-finite components, are left out.
The kept row of smallest id (ties: the smaller vector) fixes the length.  A vector of
another length, or with a component too large for distances of 64 bits (beyond
``reach``), stays in the result with null code and error and trains nothing; so do
all, if the length is no multiple of the number of parts.  A missing id comes after
every other.  Rows may repeat; fewer rows than entries give smaller codebooks; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Part searches done at a time.
STEP = 1 << 16
_NONE = np.iinfo(np.int64).max


class EqualAverage:
    """The entries of one codebook in order of their component sums."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums, self.entries = sums[self.order], entries[self.order]

    def nearest(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of each row (ties: the lower
        index), and how many distances that took."""
        dimension, last = found.shape[1], len(self.sums) - 1
        best = np.full(len(found), _NONE // max(dimension, 1), np.int64)
        index = np.zeros(len(found), np.int64)
        live, own = np.arange(len(found)), found.sum(axis=1)
        right = np.searchsorted(self.sums, own)
        left, done = right - 1, 0
        while len(live):
            below = np.where(left >= 0, own - self.sums[np.maximum(left, 0)], _NONE)
            above = np.where(right <= last, self.sums[np.minimum(right, last)] - own, _NONE)
            gap = np.minimum(below, above)
            open_ = gap < _NONE
            open_[open_] = gap[open_] ** 2 <= best[live[open_]] * dimension
            live, own, left, right, down = (a[open_] for a in (live, own, left, right, below <= above))
            at = np.where(down, left, right)
            distance = ((found[live] - self.entries[at]) ** 2).sum(axis=1)
            entry = self.order[at]
            better = (distance < best[live]) | ((distance == best[live]) & (entry < index[live]))
            better |= best[live] == _NONE // max(dimension, 1)
            index[live[better]], best[live[better]] = entry[better], distance[better]
            left, right = left - down, right + ~down
            done += len(live)
        return index, best, done


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``, and the scale that makes components integers."""

    entries: np.ndarray
    scale: int

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def search(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance, both [row, part], of rows of integer components."""
        index, distance = (np.zeros((len(numbers), len(self.entries)), np.int64) for _ in range(2))
        size = self.entries.shape[2]
        for part, book in enumerate(map(EqualAverage, self.entries)):
            for a in range(0, len(numbers), STEP):
                rows = slice(a, a + STEP)
                index[rows, part], distance[rows, part], _ = book.nearest(numbers[rows, part * size : (part + 1) * size])
        return index, distance

    def decoded(self, code: str) -> np.ndarray:
        """The vector a code stands for."""
        picked = bytes.fromhex(code)
        return np.concatenate([self.entries[part, entry] for part, entry in enumerate(picked)]) / self.scale


def reach(length: int, parts: int, scale: int) -> float:
    """The largest component whose distances and gaps stay inside 64 bits."""
    return math.isqrt(_NONE) // (2 * max(length // parts, 1)) / scale - 1


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is there and holds only finite numbers."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & sound)


def _fits(column: str, length: int, parts: int, scale: int):
    inside = F.forall(column, lambda x: F.abs(x) <= reach(length, parts, scale))
    return (F.size(column) == length) & inside


def _numbers(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    """Rows of integer components: every component times the scale, rounded down."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(vectors), length)


def train(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    key: str = "vec_id", column: str = "embedding",
) -> Codebooks | None:
    """Codebooks refined over all rows; None where no row can be cut into parts.

    A round is one pass.  Every task hands on one row per component of the codebooks,
    so what is shuffled and what reaches the driver has the codebooks' size.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hexadecimal digits: 1 to 256 entries")
    sound = kept(vectors.select(key, column), column)
    by_id = [F.col(key).asc_nulls_last(), F.col(column)]
    first = sound.orderBy(*by_id).select(F.size(column).alias("n")).first()
    if first is None or first["n"] % parts or not first["n"]:
        return None
    length = first["n"]
    size = length // parts
    usable = sound.where(_fits(column, length, parts, scale)).select(key, column)
    begin = [r[0] for r in usable.orderBy(*by_id).limit(entries).select(column).collect()]
    if not begin:
        return None
    start = np.floor(np.array(begin, np.float64) * scale).astype(np.int64)
    books = Codebooks(start.reshape(len(begin), parts, size).transpose(1, 0, 2).copy(), scale)
    shape = books.entries.shape
    for _ in range(rounds):
        cells = usable.select(column).mapInArrow(_tally(books, length), "cell int, total long")
        found = np.zeros((parts * shape[1], size + 1), np.int64)
        for r in cells.groupBy("cell").agg(F.sum("total").alias("total")).collect():
            found[r["cell"] // (size + 1), r["cell"] % (size + 1)] = r["total"]
        sums, counts = found[:, :size], found[:, size:]
        moved = np.where(counts > 0, sums // np.maximum(counts, 1), books.entries.reshape(-1, size))
        books = Codebooks(moved.reshape(shape), scale)
    return books


def _tally(books: Codebooks, length: int):
    """For each entry the sums of the parts nearest to it, and last their number."""
    parts, entries, size = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            numbers = _numbers(batch.column(0), length, books.scale)
            index, _ = books.search(numbers)
            for part in range(parts):
                order = np.argsort(index[:, part], kind="stable")
                used, begins = np.unique(index[order, part], return_index=True)
                if len(used):
                    mine = numbers[order, part * size : (part + 1) * size]
                    total[part, used, :size] += np.add.reduceat(mine, begins, axis=0)
                    total[part, used, size] += np.diff(np.append(begins, len(order)))
        flat = total.ravel()
        cell = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(flat[cell])], names=["cell", "total"])

    return run


def encoded(vectors: DataFrame, books: Codebooks | None, carry: list[str], column: str = "embedding") -> DataFrame:
    """The carried columns, code (two hexadecimal digits a part) and error (squared
    distance over all parts) of every kept row."""
    sound = kept(vectors, column)
    if books is None:
        return sound.select(*carry, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    parts = len(books.entries)
    fit = _fits(column, books.length, parts, books.scale)
    rows = sound.select(*carry, F.when(fit, F.col(column)).alias("_vector"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(batch.num_columns - 1)
            there = given.is_valid()
            index, distance = books.search(_numbers(given.filter(there), books.length, books.scale))
            hexed = index.astype(np.uint8).tobytes().hex()
            found = pa.table({
                "code": pa.array([hexed[i : i + 2 * parts] for i in range(0, len(hexed), 2 * parts)], pa.string()),
                "error": pa.array(distance.sum(axis=1)),
            })
            place = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
            take = pa.array(place, mask=~there.to_numpy(zero_copy_only=False))
            added = [found.column(c).combine_chunks().take(take) for c in ("code", "error")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=schema.names)

    return rows.mapInArrow(run, schema)
