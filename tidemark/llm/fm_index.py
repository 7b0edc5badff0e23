"""A compressed FM-index over word sequences, and substring deduplication with it.

The index of a shard is the Burrows-Wheeler transform of its stretches, held in a
wavelet matrix of packed bits with a running count per 64 bits.  Backward search
on it gives the matching statistics of many sequences at once: for every place the
longest stretch starting there that occurs at least twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import blocks, repeats
from tidemark.llm.suffixes import common_prefixes, doubled, places

_U = np.uint64


class Bits:
    """A packed bit vector that counts its ones before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(_U)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        rest = self.words[word] & ((_U(1) << (at & 63).astype(_U)) - _U(1))
        return self.before[word] + np.bitwise_count(rest)


class Wavelet:
    """How often a letter occurs before a place, in one step per bit of the letter."""

    def __init__(self, letters: np.ndarray, n_letters: int):
        self.levels: list[tuple[int, Bits, int]] = []
        row = letters
        for bit in range(max(int(n_letters - 1).bit_length(), 1) - 1, -1, -1):
            ones = ((row >> bit) & 1).astype(np.uint8)
            self.levels.append((bit, Bits(ones), len(row) - int(np.count_nonzero(ones))))
            row = np.concatenate((row[ones == 0], row[ones == 1]))
        self.starts = np.zeros(n_letters, np.int64)
        self.starts = self._follow(np.arange(n_letters), np.zeros(n_letters, np.int64))

    def _follow(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((letter >> bit) & 1, zeros + ones, at - ones)
        return at

    def count(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._follow(letter, at) - self.starts[letter]


class FMIndex:
    """Backward search over ``text`` (its only 0 at the end); each place has a weight."""

    def __init__(self, text: np.ndarray, weights: np.ndarray, n_letters: int):
        n = len(text)
        self.n, kind = n, places(n)
        order = doubled(text).astype(kind)
        self.wavelet = Wavelet(text[order - 1].astype(kind), n_letters)
        sizes = np.bincount(text, minlength=n_letters)
        self.first = np.cumsum(sizes) - sizes
        self.weight = np.concatenate(([0], np.cumsum(weights[order])))
        shared = np.full(n + 1, -1, kind)
        shared[1:n] = common_prefixes(text, order)[order[1:]]
        self.shared = shared
        self.left, self.right = _nearest_smaller(shared), n - _nearest_smaller(shared[::-1])[::-1]

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelet.count(np.concatenate((letter, letter)), np.concatenate((low, high)))
        return self.first[letter] + both[: len(letter)], self.first[letter] + both[len(letter) :]

    def matching(self, letters: np.ndarray, ends: np.ndarray, sizes: np.ndarray, least: int = 2) -> np.ndarray:
        """For every letter of the sequences the longest match from there of weight ``least``.

        Sequence i is ``letters[ends[i] - sizes[i] : ends[i]]``.  All are read from
        the right at once; where a match cannot grow it falls back to the parent
        interval, the longest shorter match.
        """
        out = np.zeros(len(letters), np.int64)
        at, stop = ends - 1, ends - sizes
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        depth = np.zeros(len(ends), np.int64)
        live = np.flatnonzero(at >= stop)
        while len(live):
            a, b = self.step(letters[at[live]], low[live], high[live])
            grows = self.weight[b] - self.weight[a] >= least
            on = live[grows]
            low[on], high[on] = a[grows], b[grows]
            depth[on] += 1
            out[at[on]] = depth[on]
            root = live[~grows & (depth[live] == 0)]
            back = live[~grows & (depth[live] > 0)]
            x, y = self.shared[low[back]], self.shared[high[back]]
            edge = np.where(x >= y, low[back], high[back])
            depth[back] = np.maximum(np.maximum(x, y), 0)
            top = np.maximum(x, y) <= 0
            low[back] = np.where(top, 0, self.left[edge])
            high[back] = np.where(top, self.n, self.right[edge])
            at[on] -= 1
            at[root] -= 1
            live = live[at[live] >= stop[live]]
        return out


def _nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For every place the nearest one to the left with a smaller value, else 0."""
    near = np.arange(len(values), dtype=places(len(values))) - 1
    while True:
        bad = np.flatnonzero((near >= 0) & (values[np.maximum(near, 0)] >= values))
        if not len(bad):
            return np.maximum(near, 0)
        near[bad] = near[near[bad]]


def repeated_windows(data: np.ndarray, sizes: np.ndarray, counts: np.ndarray, window: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the pieces (words joined by spaces) occur again, and windows per piece.

    A piece stands for ``counts`` equal stretches of documents.
    """
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    starts, ends, first = blocks.words(data, offsets)
    n_words = np.diff(first)
    known, letters = np.unique(blocks.word_hashes(data, starts, ends, fold=False, seed=seed), return_inverse=True)
    letters = letters.astype(np.int64) + 2
    pieces = len(sizes)
    text = np.ones(len(letters) + pieces + 1, np.int64)
    at = np.arange(len(letters)) + np.repeat(np.arange(pieces), n_words)
    text[at] = letters
    text[-1] = 0
    weights = np.zeros(len(text), np.int64)
    weights[at] = np.repeat(counts, n_words)
    del at
    index = FMIndex(text, weights, len(known) + 2)
    longest = index.matching(letters, first[1:], n_words)
    room = np.repeat(first[1:], n_words) - np.arange(len(letters)) >= window
    return longest[room] >= window, n_words - window + 1


def _search(window: int, gram: int) -> tuple[repeats.Search, repeats.Index]:
    search = repeats.Search(window, gram, by_word=True, earlier=False)

    def index(data: np.ndarray, sizes: np.ndarray, owners: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        again, windows = repeated_windows(data, sizes, counts, window, search.seed)
        return np.where(again, 0, repeats.NOWHERE), windows

    return search, index


def _kept_texts(there: repeats.Texts, mask: np.ndarray) -> list[bytes]:
    """The kept words of every text, joined by one space."""
    stay = np.flatnonzero(~mask)
    lengths = (there.ends - there.begins)[stay]
    laid = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    joined[blocks.spread(laid, lengths)] = there.data[blocks.spread(there.begins[stay], lengths)]
    ends = np.append(laid, len(joined))[np.searchsorted(stay, there.offsets)]
    raw = joined.tobytes()
    return [raw[a : max(b - 1, a)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def deduplicated(docs: DataFrame, window: int = 35, gram: int = 8, with_kept: bool = True) -> DataFrame:
    """Each row of ``docs`` without the words of every stretch that occurs elsewhere too.

    A word goes if ``window`` consecutive words of its document cover it that also
    start at another place, in the same document or in any other row.  Returns
    doc_id, n_words, n_removed, kept_sha256 and ``kept`` (kept words joined by one
    space; null unless ``with_kept``).

    Rows: a null or blank text has no words and the hash of nothing; null and
    repeated ids are rows like any other; an empty table gives an empty result;
    further columns are ignored.
    """
    search, index = _search(window, gram)

    def finish(rows: pa.Table, there: repeats.Texts, mask: np.ndarray) -> pa.RecordBatch:
        gone = np.concatenate(([0], np.cumsum(mask)))
        texts = _kept_texts(there, mask)
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").combine_chunks().cast(pa.int64()),
                pa.array(np.diff(there.offsets), pa.int64()),
                pa.array(np.diff(gone[there.offsets]), pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array([t.decode() for t in texts], pa.string()) if with_kept else pa.nulls(len(texts), pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )

    return repeats.removed(docs, search, index, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def shortened(docs: DataFrame, window: int = 35, gram: int = 8) -> DataFrame:
    """The rows of ``docs`` with repeated stretches cut out of ``text`` and ``n_chars`` set anew.

    A text that loses nothing stays as it is, line ends included; rows that lose all
    their words are dropped.  Other columns are carried unchanged, whatever their names.

    Rows: a null text becomes an empty one and stays, as blank texts do; null and repeated
    ids are rows like any other; an empty table gives an empty one; a text of any length
    is cut whole.
    """
    search, index = _search(window, gram)
    # Numbered on the way, so that no column has a name that the exchange uses.
    names = {c: c if c in ("doc_id", "text", "n_chars") else f"column{i}" for i, c in enumerate(docs.columns)}
    carry = [name for name in names.values() if name not in ("text", "n_chars")]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def finish(rows: pa.Table, there: repeats.Texts, mask: np.ndarray) -> pa.RecordBatch:
        gone = np.concatenate(([0], np.cumsum(mask)))
        lost = np.diff(gone[there.offsets])
        texts = [t.decode() for t in _kept_texts(there, mask)]
        for i in np.flatnonzero(lost == 0):
            texts[i] = there.text(i)
        left = np.diff(there.offsets) - lost
        stay = (lost == 0) | (left > 0)
        columns = {c: rows.column(c).combine_chunks() for c in carry}
        columns["text"] = pa.array(texts, pa.string())
        columns["n_chars"] = pa.array([len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([columns[names[c]] for c in schema.names], names=schema.names).filter(pa.array(stay))

    return repeats.removed(docs.toDF(*names.values()), search, index, finish, schema, carry)
