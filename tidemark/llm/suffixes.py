"""Suffix arrays of one shard by induced sorting, and permuted common prefixes.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller (LMS) substrings,
names them, sorts the reduced string recursively and induces the whole order from
the LMS suffixes.  Inducing goes bucket by bucket in numpy: within a bucket the
suffixes known so far induce their left neighbours in one vector step, repeated
while the bucket still grows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import repeats


#: Strings of more letters than this are sorted by doubling instead of by bucket.
MANY_LETTERS = 512


def places(n: int) -> type:
    """The smallest type that holds every place of a text of n letters."""
    return np.int32 if n < 1 << 31 else np.int64


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour's; the last one is."""
    n = len(text)
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    smaller = np.ones(n, bool)
    smaller[:-1] = text[:-1] < text[1:]
    at = np.where(differs, np.arange(n, dtype=places(n)), n - 1)
    return smaller[np.minimum.accumulate(at[::-1])[::-1]]


def _induced(text: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array that follows when ``lms`` is placed at the bucket ends in this order."""
    n, letters = len(text), len(sizes)
    starts = np.cumsum(sizes) - sizes
    order = np.full(n, -1, places(n))
    head, tail = starts.copy(), starts + sizes

    def grouped(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.argsort(chars, kind="stable")
        counts = np.bincount(chars, minlength=letters)
        first = np.cumsum(counts) - counts
        return by, counts, np.arange(len(chars)) - first[chars[by]]

    chars = text[lms]
    by, counts, nth = grouped(chars)
    order[tail[chars[by]] - counts[chars[by]] + nth] = lms[by]
    lms_begin = tail - counts

    def push_large(found: np.ndarray) -> None:
        left = found[found > 0] - 1
        left = left[~small[left]]
        if len(left):
            chars = text[left]
            by, counts, nth = grouped(chars)
            order[head[chars[by]] + nth] = left[by]
            np.add(head, counts, out=head)

    for c in np.flatnonzero(sizes):
        at = starts[c]
        while at < head[c]:
            upto = head[c]
            push_large(order[at:upto])
            at = upto
        push_large(order[lms_begin[c] : tail[c]])
    # The LMS suffixes only helped to find the large ones; now all small ones are placed.
    large_end = head.copy()
    last = starts + sizes

    def push_small(found: np.ndarray) -> None:
        left = found[found > 0] - 1
        left = left[small[left]]
        if len(left):
            chars = text[left]
            by, counts, nth = grouped(chars)
            order[last[chars[by]] - 1 - nth] = left[by]
            np.subtract(last, counts, out=last)

    sentinel = np.flatnonzero(sizes)[0]
    order[starts[sentinel]] = n - 1
    last[sentinel] -= 1
    for c in np.flatnonzero(sizes)[::-1]:
        upto = starts[c] + sizes[c]
        if c == sentinel:
            push_small(order[starts[c] : upto])
            break
        while upto > last[c]:
            down = last[c]
            push_small(order[down:upto][::-1])
            upto = down
        push_small(order[starts[c] : large_end[c]][::-1])
    return order


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Equal names for equal LMS substrings, in sorted order; ``ordered`` are LMS places."""
    after = np.full(len(text), len(text), np.int64)
    after[lms[:-1]] = lms[1:]
    length = np.where(after[ordered] < len(text), after[ordered] - ordered + 1, len(text) - ordered)
    left, right = ordered[:-1], ordered[1:]
    same = (length[:-1] == length[1:]) & (text[left] == text[right])
    live, step = np.flatnonzero(same), 1
    while len(live):
        live = live[step < length[live]]
        equal = text[left[live] + step] == text[right[live] + step]
        same[live[~equal]] = False
        live = live[equal]
        step += 1
    return np.concatenate(([0], np.cumsum(~same)))


def doubled(text: np.ndarray) -> np.ndarray:
    """The suffix array of a string of many letters: ranks of as many letters as 62 bits
    hold, then of twice, four times, ... as many.

    A rank is the first place of its group, so groups of one are final and only the
    others are sorted again.
    """
    n, letters = len(text), int(text.max()) + 2
    span = max(1, int(62 / np.log2(letters)))
    keys = np.zeros(n, np.int64)
    for step in range(min(span, n)):
        # A letter behind the end is less than every other.
        keys *= letters
        keys[: n - step] += text[step:]
        keys[: n - step] += 1
    order = np.argsort(keys).astype(places(n))
    rank = np.empty(n, places(n))
    live, keys = np.arange(n, dtype=places(n)), keys[order]
    while True:
        fresh = np.ones(len(live) + 1, bool)
        fresh[1:-1] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(fresh[:-1])
        rank[order[live]] = np.repeat(live[starts], np.diff(np.append(starts, len(live))))
        live = live[~(fresh[:-1] & fresh[1:])]
        if not len(live):
            return order
        items = order[live]
        after = items.astype(np.int64) + span
        keys = rank[items].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(keys)
        order[live], keys = items[by], keys[by]
        span *= 2


def suffix_array(text: np.ndarray, letters: int) -> np.ndarray:
    """Places of all suffixes in order; ``text`` must end with its only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    if letters > MANY_LETTERS:
        # A step per bucket does not pay where buckets hold next to nothing; the
        # reduced string's repeats are short, so few doublings finish it.
        return doubled(text)
    text = text.astype(np.uint16 if letters <= 65536 else np.int64, copy=False)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(text, minlength=letters)
    order = _induced(text, small, lms, sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = order[is_lms[order]]
    names = _names(text, lms, ordered)
    if names[-1] + 1 < len(lms):
        by_place = np.zeros(n, np.int64)
        by_place[ordered] = names
        ordered = lms[suffix_array(by_place[lms], int(names[-1]) + 1)]
    return _induced(text, small, ordered, sizes)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """PLCP: for every place, the letters its suffix shares with the one sorted before it.

    Only irreducible values are compared letter by letter: where the letters to
    the left agree, the value is one less than that of the place to the left.
    """
    n = len(text)
    before = np.full(n, -1, places(n))
    before[order[1:]] = order[:-1]
    left_differs = np.ones(n, bool)
    at = np.flatnonzero(before[1:] > 0) + 1
    left_differs[at] = text[at - 1] != text[before[at] - 1]
    live = np.flatnonzero(left_differs & (before >= 0))
    shared = np.zeros(n, places(n))
    step = 0
    if text.dtype == np.uint8:
        # Eight letters at a time; the end counts as letters that differ.
        padded = np.concatenate((text, np.zeros(8, np.uint8)))
        eight = np.ndarray(n, np.uint64, padded.data, strides=(1,))
        while len(live):
            off = eight[live + step] ^ eight[before[live] + step]
            lowest = off & (~off + np.uint64(1))
            equal = np.where(off == 0, 8, np.bitwise_count(lowest - np.uint64(1)) >> 3)
            reach = n - step - np.maximum(live, before[live])
            shared[live] += np.minimum(equal, reach)
            live = live[(equal == 8) & (reach > 8)]
            step += 8
    while len(live):
        live = live[(live + step < n) & (before[live] + step < n)]
        equal = text[live + step] == text[before[live] + step]
        live = live[equal]
        shared[live] += 1
        step += 1
    place = np.arange(n, dtype=places(n))
    known = np.where(left_differs, shared + place, 0)
    return np.maximum(np.maximum.accumulate(known) - place, 0)


def owners_of_windows(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """For every window of every piece the smallest document that holds those bytes.

    The pieces lie in a row in ``data``; ``docs`` has one document for each.  UTF-8
    never uses the bytes above 0xF4, so all letters, a separator and 0 fit one byte.
    """
    pieces = len(sizes)
    begins = np.cumsum(sizes) - sizes
    text = np.ones(len(data) + pieces + 1, np.uint8)
    places = np.arange(len(data)) + np.repeat(np.arange(pieces), sizes)
    text[places] = data + np.uint8(2)
    text[-1] = 0
    order = suffix_array(text, 256)
    shared = common_prefixes(text, order)
    roomy = np.zeros(len(text), bool)
    roomy[places] = np.repeat(begins + sizes, sizes) - np.arange(len(data)) >= window
    doc = np.zeros(len(text), np.int64)
    doc[places] = np.repeat(docs, sizes)
    full = order[roomy[order]]
    out = np.zeros(len(text), np.int64)
    if len(full):
        # Suffixes that agree on a window stand side by side; a class begins where they stop to.
        starts = np.flatnonzero(np.concatenate(([True], shared[full[1:]] < window)))
        least = np.minimum.reduceat(doc[full], starts)
        out[full] = np.repeat(least, np.diff(np.append(starts, len(full))))
    return out[roomy]


def deduplicated(docs: DataFrame, window: int = 50, gram: int = 16, with_kept: bool = True, none_last: bool = True) -> DataFrame:
    """Each row of ``docs`` without the bytes that a smaller doc_id already has.

    A byte goes if a ``window``-byte string that covers it also starts in a document
    with a smaller id.  Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    ``kept`` (the remaining bytes, which need not be whole characters; null unless
    ``with_kept``).

    Rows: a null or empty text gives zeros and the hash of nothing; a null id comes
    after every other id, or, unless ``none_last``, no id is smaller than it, so that the
    row loses nothing; rows with the same id do not take bytes from each other;
    an empty table gives an empty result; further columns are ignored.
    """
    search = repeats.Search(window, gram, by_word=False, earlier=True, none_last=none_last)

    def index(data: np.ndarray, sizes: np.ndarray, owners: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return owners_of_windows(data, sizes, owners, window), sizes - window + 1

    def finish(rows: pa.Table, there: repeats.Texts, mask: np.ndarray) -> pa.RecordBatch:
        edge = np.ones(len(mask) + 1, bool)
        edge[1:-1] = ~mask[:-1]
        edge[there.offsets] = True
        opens = np.concatenate(([0], np.cumsum(mask & edge[:-1])))
        gone = np.concatenate(([0], np.cumsum(mask)))
        left, begins = repeats.kept(there, mask)
        texts = [left[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").combine_chunks().cast(pa.int64()),
                pa.array(np.diff(there.offsets), pa.int64()),
                pa.array(np.diff(gone[there.offsets]), pa.int64()),
                pa.array(np.diff(opens[there.offsets]), pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array(texts, pa.binary()) if with_kept else pa.nulls(len(texts), pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return repeats.removed(docs, search, index, finish, schema)
