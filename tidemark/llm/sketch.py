"""Threshold-scaled document fingerprints and how they change under an edit.

A fingerprint keeps every shingle hash below a fixed fraction of all hashes.  Its
size follows the text's, sketches of parts merge by union, and the kept hashes of
two texts estimate Jaccard similarity or, however unequal the texts, containment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks, exchange

WIDTH = 8  # bytes of a shingle
SCALE = 16  # one hash in so many is kept
_DIGITS = 11
_U = np.uint64
_LIMIT = (1 << 64) // SCALE


class Sketches:
    """The kept hashes of many texts, ascending and distinct in each, and a digest of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rolling, n_texts = blocks.Rolling(blocks.BYTE_VALUE[data]), len(offsets) - 1
        hashes = rolling.windows(WIDTH)
        inside = np.zeros(len(data) + 1, np.int64)
        size = np.diff(offsets)
        long = size >= WIDTH
        # Windows begin at all places of a text but its last few.
        np.add.at(inside, offsets[:-1][long], 1)
        np.add.at(inside, offsets[1:][long] - WIDTH + 1, -1)
        valid = np.cumsum(inside)[: len(hashes)] > 0
        short = np.flatnonzero(~long & (size > 0))
        whole = rolling.of(offsets[:-1][short], offsets[1:][short])
        total = np.concatenate((np.zeros(1, _U), np.cumsum(np.where(valid, hashes, _U(0)))))
        self.digest = total[np.minimum(offsets[1:], len(hashes))] - total[np.minimum(offsets[:-1], len(hashes))]
        self.digest[short] = whole
        self.windows = np.where(long, size - WIDTH + 1, np.minimum(size, 1))
        kept = np.flatnonzero(valid & (hashes < _U(_LIMIT)))
        doc = np.searchsorted(offsets, kept, side="right") - 1
        low = whole < _U(_LIMIT)
        doc, values = np.concatenate((doc, short[low])), np.concatenate((hashes[kept], whole[low])) >> _U(64 - 4 - 4 * _DIGITS)
        order = np.lexsort((values, doc))
        doc, values = doc[order], values[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
        self.values, self.doc = values[new], doc[new]
        self.begins = np.searchsorted(self.doc, np.arange(n_texts + 1))

    def strings(self) -> list[str]:
        """windows : digest : kept hashes, in hexadecimal."""
        digits = np.zeros((len(self.values), _DIGITS), np.uint8)
        for i in range(_DIGITS):
            digit = ((self.values >> _U(4 * (_DIGITS - 1 - i))) & _U(15)).astype(np.uint8)
            digits[:, i] = digit + np.where(digit < 10, 48, 87)
        text = digits.tobytes().decode()
        ends = (self.begins * _DIGITS).tolist()
        heads = zip(self.windows.tolist(), self.digest.tolist(), ends[:-1], ends[1:], strict=True)
        return [f"{n:x}:{d:016x}:{text[a:b]}" for n, d, a, b in heads]

    def near(self, own: np.ndarray, other: Sketches, its: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarity of text own[i] here and its[i] there.

        Equal digests are equal texts; two texts too short to keep any hash are
        alike only then.
        """
        rows = np.arange(len(own))
        n, m = np.diff(self.begins)[own], np.diff(other.begins)[its]
        a, b = self.values[blocks.spread(self.begins[own], n)], other.values[blocks.spread(other.begins[its], m)]
        row, value = np.concatenate((np.repeat(rows, n), np.repeat(rows, m))), np.concatenate((a, b))
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
        shared = np.bincount(row[1:][same], minlength=len(own))
        equal = (self.digest[own] == other.digest[its]) & (self.windows[own] == other.windows[its])
        return np.where(equal, 1.0, shared / np.maximum(n + m - shared, 1))


def parse(fingerprint: str) -> set[str]:
    """The kept hashes of a fingerprint."""
    text = fingerprint.rsplit(":", 1)[1]
    return {text[i : i + _DIGITS] for i in range(0, len(text), _DIGITS)}


def containment(part: str, whole: str) -> float:
    """Estimated share of the shingles of ``part`` that ``whole`` has; 0 where nothing was kept."""
    kept = parse(part)
    return len(kept & parse(whole)) / len(kept) if kept else 0.0


def _edited(texts: list[bytes], nexts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Code points of each text, and the text with its last quarter taken from the next one."""
    n_chars, out = [], []
    for text, following in zip(texts, nexts, strict=True):
        whole, other = text.decode(), following.decode()
        quarter = len(whole) // 4
        n_chars.append(len(whole))
        out.append((whole[: len(whole) - quarter] + other[:quarter]).encode())
    return np.array(n_chars, np.int64), out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """A fingerprint of every text and of its edited text (see ``_edited``), and likenesses.

    The next document is the next by doc_id; after the last comes the first.  Texts
    are dealt once, compressed, into ranges of ids; the first document of a range is
    also sent to the range before it, so nothing else crosses ranges.

    Rows: a null text is empty; rows without id come last, ordered by a hash of
    their text; rows with one id are ordered by text; a lone row is its own next;
    an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    pieces = exchange.pieces(docs)
    # Ranges of the ids: a quantile sketch gives their bounds, one number per range.
    rows = docs.select("doc_id", "text")
    bounds = rows.approxQuantile("doc_id", [i / pieces for i in range(1, pieces)], 0.25 / pieces) if pieces > 1 else []
    cuts = np.unique(np.array(bounds, np.int64))
    even = np.linspace(-(2.0**63), 2.0**63, pieces + 1)[1:-1].astype(np.int64)
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.col("doc_id"))
    keyed = rows.select(F.col("doc_id").isNull().alias("late"), place.alias("place"), "doc_id", "text")

    def ranges(late: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(late, len(cuts) + 1 + np.searchsorted(even, place, side="right"), np.searchsorted(cuts, place, side="right"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            late, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("late", "place"))
            yield pa.RecordBatch.from_arrays([pa.array(ranges(late, place), pa.int32()), batch.column("place")], names=["range", "place"])

    # One row per range: where it begins.
    first = {
        r["range"]: r["place"]
        for r in keyed.select("late", "place").mapInArrow(locate, "range int, place long").groupBy("range").agg(F.min("place").alias("place")).collect()
    }
    present = sorted(first)
    before = {r: present[i - 1] for i, r in enumerate(present)}
    known = np.array(present, np.int64)
    firsts = np.array([first[r] for r in present], np.int64)
    befores = np.array([before[r] for r in present], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            late, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("late", "place"))
            own = ranges(late, place)
            at = np.searchsorted(known, own)
            opens = np.flatnonzero(firsts[at] == place)
            take = pa.array(np.concatenate((np.arange(len(own)), opens)))
            texts = pa.array([press.compress(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((own, befores[at[opens]])), pa.int32()),
                    pa.array(np.arange(len(take)) >= len(own)),
                    batch.column("place").take(take), batch.column("doc_id").take(take), texts.take(take),
                ],
                names=["range", "ahead", "place", "doc_id", "z"],
            )

    def sketch(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        columns = [table.column(c).to_pylist() for c in ("ahead", "place", "doc_id", "z")]
        ordered = sorted((a, p, open_.decompress(z), d) for a, p, d, z in zip(*columns, strict=True))
        own = [r for r in ordered if not r[0]]
        following = [r[2] for r in own[1:]] + [next(r[2] for r in ordered if r[0])]
        out, at = [], 0
        while at < len(own):
            stop, held = at, 0
            while stop < len(own) and (stop == at or held + len(own[stop][2]) <= blocks.BLOCK_BYTES // 2):
                held += len(own[stop][2])
                stop += 1
            texts = [r[2] for r in own[at:stop]]
            n_chars, edited = _edited(texts, following[at:stop])
            plain, changed = Sketches(*_joined([*texts, following[stop - 1]])), Sketches(*_joined(edited))
            some = np.arange(len(texts))
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array([r[3] for r in own[at:stop]], pa.int64()),
                        "n_chars": n_chars,
                        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in edited],
                        "fingerprint": plain.strings()[:-1],
                        "edited_fingerprint": changed.strings(),
                        "near_edited": plain.near(some, changed, some),
                        "near_next": plain.near(some, plain, some + 1),
                    }
                )
            )
            at = stop
        return pa.concat_tables(out)

    if not present:
        return spark.createDataFrame([], OUT)
    dealt = keyed.mapInArrow(deal, "range int, ahead boolean, place long, doc_id long, z binary")
    return dealt.groupBy("range").applyInArrow(sketch, OUT)
