"""Windows of symbols that occur more than once, found without moving whole texts.

A window is ``window`` symbols in a row (bytes or words) of one document.  Its
anchor is the least hash among its ``gram``-symbol pieces, so equal windows have
equal anchors.  Exchanges with shards (see ``exchange``) find the repeats:

1. Each bucket sends its distinct anchors; a shard answers which occur again.
2. For those, the bucket sends the hash of the stretch of symbols around the anchor,
   each different stretch once with its first document and its count, to the shard of
   the anchor.  Of the buckets that hold a stretch the shard asks one for its text.
3. That bucket sends the text.  So a text that many buckets hold is on disk once: copies
   become more with the size of the corpus, and what is sent of each copy does not.
4. The shard indexes its stretches and answers for each which of its windows repeat.
   What index it uses is the caller's choice.
5. The bucket marks the symbols of those windows in its texts.

An anchor that very many stretches share does not fill one shard: its stretches
are cut into single windows, and each goes to the shard of its own hash.

The rows of equal anchors are only candidates; windows are compared symbol by
symbol in the shard's index.  Equal stretches, and equal words, are told by hashes of
64 bits that are drawn anew for every job, so no text can be made to be confused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm import blocks, exchange

#: Bytes beyond which a bucket is worked in several blocks; a block takes a hundred times as much.
BLOCK = 1 << 20
_SLOTS = 1 << 40
_U = np.uint64


@dataclass(frozen=True)
class Texts:
    """Some documents as symbols: hashes, where documents begin, and the bytes behind."""

    symbols: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    begins: np.ndarray  # of each symbol in data
    ends: np.ndarray
    bounds: np.ndarray  # of each document in data

    def text(self, number: int) -> str:
        return self.data[self.bounds[number] : self.bounds[number + 1]].tobytes().decode()


@dataclass(frozen=True)
class Search:
    """What repeats: ``earlier`` wants the other one in a document of smaller id,
    else it may be anywhere, in the same document too."""

    window: int
    gram: int
    by_word: bool
    earlier: bool
    #: Whether a row without id comes after every other; if not, no id is smaller than none.
    none_last: bool = True
    #: Anchors that occur this often are dealt out window by window.
    crowded: int = 4000
    #: Of the hashes; each job has its own.
    seed: int = field(default_factory=blocks.fresh_seed)

    def texts(self, texts: pa.Array) -> Texts:
        data, offsets = blocks.flat(texts)
        if self.by_word:
            starts, ends, first = blocks.words(data, offsets)
            return Texts(blocks.word_hashes(data, starts, ends, fold=False, seed=self.seed), first, data, starts, ends, offsets)
        places = np.arange(len(data))
        return Texts(blocks.byte_values(self.seed)[data], offsets, data, places, places + 1, offsets)

    def rolling(self, texts: Texts) -> blocks.Rolling:
        return blocks.Rolling(texts.symbols, self.seed)

    def own(self, texts: Texts, rolling: blocks.Rolling, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash by which a stretch is known."""
        return blocks.digested(rolling.of(first, end), texts.symbols, first, end, self.seed, 2 * blocks.LONG)


@dataclass(frozen=True)
class Runs:
    """Windows in a row with one anchor: first window, one past the last, anchor, and
    whether some window holds the anchor's piece twice (not told where ``earlier``)."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    twice: np.ndarray


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of every ``reach`` values in a row."""
    span = 1
    while span * 2 <= reach:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if reach > span:
        values = np.minimum(values[: len(values) - (reach - span)], values[reach - span :])
    return values


def runs(search: Search, texts: Texts) -> Runs:
    none = np.zeros(0, np.int64)
    grams = search.rolling(texts).windows(search.gram)
    reach = search.window - search.gram + 1
    if len(grams) < reach:
        return Runs(none, none, none.astype(_U), none.astype(bool))
    # The low bits tell equal grams at different places apart.  Places count from the beginning of the
    # document, so that its runs are the same whichever documents a block has before it.
    place = np.resize(np.arange(256, dtype=np.uint8), len(texts.symbols))
    place -= np.repeat((texts.offsets[:-1] & 63).astype(np.uint8), np.diff(texts.offsets))
    place, high = (place[: len(grams)] & np.uint8(63)).astype(_U), grams & ~_U(63)
    least = _least(high | place, reach)
    inside = np.ones(len(least) + 1, bool)
    inside[-1] = False
    edges = texts.offsets[1:-1]
    if len(edges):
        stop = blocks.covered(np.clip(edges - search.window + 1, 0, len(least)), np.clip(edges, 0, len(least)), len(least))
        inside[:-1] &= ~stop
    turn = np.ones(len(least) + 1, bool)
    turn[1:-1] = (least[1:] != least[:-1]) | ~inside[:-2]
    first = np.flatnonzero(turn[:-1] & inside[:-1])
    last = np.flatnonzero(inside[:-1] & (turn[1:] | ~inside[1:])) + 1
    twice = np.zeros(len(first), bool)
    if not search.earlier:
        # Counting places down, an only piece is found at the same place again.
        other = _least(high | (_U(63) - place), reach)
        ties = np.concatenate(([0], np.cumsum((least ^ other) & _U(63) != _U(63))))
        twice = ties[last] > ties[first]
    return Runs(first, last, blocks.mixed(least[first] >> _U(6)), twice)


def _code(anchor: np.ndarray, shards: int) -> np.ndarray:
    return anchor % _U(shards * _SLOTS)


#: What the seven bits of a told count stand for: small ones exactly, others to a fifth.
_COUNTS = np.array([c if c < 64 else int(64 * 2 ** ((c - 64) / 4)) for c in range(128)], np.int64)


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in seven bits, rounded down; up to three million."""
    return (np.searchsorted(_COUNTS, counts, side="right") - 1).astype(np.int64)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for some in np.split(order, cuts):
        if len(some):
            yield int(shard[some[0]]), some


def _ask_anchors(search: Search, shards: int) -> Callable:
    def question(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        codes, owner, twice = [], [], []
        for rows, texts in exchange.opened(table, BLOCK):
            there = search.texts(texts)
            found = runs(search, there)
            codes.append(_code(found.anchor, shards))
            twice.append(found.twice)
            doc = np.searchsorted(there.offsets, found.first, side="right") - 1
            owner.append(exchange.doc_ids(rows)[doc])
        codes, owner, twice = np.concatenate(codes), np.concatenate(owner), np.concatenate(twice)
        order = np.lexsort((owner, codes)) if search.earlier else np.argsort(codes)
        codes, owner, twice = codes[order], owner[order], twice[order]
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(codes)))
        if search.earlier:
            again = owner[starts] != owner[starts + counts - 1]
        else:
            again = (counts > 1) | (np.maximum.reduceat(twice, starts) if len(starts) else False)
        told = (_small(counts) | (again << 7)).astype(np.uint8)
        codes = codes[starts]
        bucket = table.column("_bucket")[0].as_py()
        slot = codes // _U(shards)
        for shard, some in _by_shard((codes % _U(shards)).astype(np.int64)):
            yield shard, bucket, blocks.packed(slot[some].astype(np.uint32), (slot[some] >> _U(32)).astype(np.uint8), told[some])

    return question


def _answer_anchors(search: Search, shards: int) -> Callable:
    def reply(shard: int, buckets: list[int], found: list[bytes]) -> Iterator[tuple[int, bytes]]:
        read = [blocks.unpacked(b, np.uint32, np.uint8, np.uint8) for b in found]
        slots = [low.astype(_U) | (high.astype(_U) << _U(32)) for low, high, _ in read]
        every, sizes = np.concatenate(slots), np.array([len(s) for s in slots])
        told = np.concatenate([t for _, _, t in read]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(every[order]) != 0)))
        counts = np.add.reduceat(_COUNTS[told[order] & 127], starts)
        again = np.add.reduceat((told[order] >> 7) + 1, starts) > 1
        mark = np.repeat(np.where(again, 1 + (counts >= search.crowded), 0), np.diff(np.append(starts, len(every))))
        marks = np.zeros(len(every), np.uint8)
        marks[order] = mark
        ends = np.cumsum(sizes)
        for bucket, slot, end in zip(buckets, slots, ends, strict=True):
            here = marks[end - len(slot) : end]
            hit = here > 0
            if hit.any():
                # A bit for each anchor in the order asked: the bucket can tell which they were.
                yield bucket, blocks.packed(np.packbits(hit), here[hit], np.array([shard, len(slot)]))

    return reply


class _Lookup:
    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are known, and the place of each (0 where unknown)."""
        if not len(self.keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted, self.order[at]


def _single(found: Runs, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = blocks.spread(found.first[some], (found.last - found.first)[some])
    return first, first + 1


def _firsts(keys: np.ndarray, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys (equal ones by ``ties``), and where each different key begins in it."""
    order = np.lexsort((*ties, keys)) if ties else np.argsort(keys, kind="stable")
    return order, np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0))) if len(keys) else np.zeros(0, np.int64)


def _planes(values: np.ndarray) -> np.ndarray:
    """64-bit numbers byte by byte, the lowest bytes of all first: bytes that are alike then stand together."""
    return np.ascontiguousarray(values.astype(_U, copy=False).view(np.uint8).reshape(-1, 8).T).ravel()


def _numbers(planes: np.ndarray, kind: type = _U) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def _steps(ascending: np.ndarray) -> np.ndarray:
    """The differences of ascending numbers, which have fewer bytes than they."""
    return _planes(np.diff(ascending, prepend=_U(0)))


def _sums(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(_numbers(planes), dtype=_U)


def _known_anchors(codes: np.ndarray, replies: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur again, of those that a bucket asked about, and their marks."""
    every = np.unique(codes)
    order = np.argsort((every % _U(shards)).astype(np.int64), kind="stable")
    cuts = np.searchsorted((every % _U(shards)).astype(np.int64)[order], np.arange(shards + 1))
    known, marks = [], []
    for bits, mark, (shard, n) in (blocks.unpacked(b, np.uint8, np.uint8, np.int64) for b in replies):
        asked = every[order[cuts[shard] : cuts[shard + 1]]]
        if len(asked) != n:
            raise RuntimeError(f"shard {shard} was asked about {n} anchors, not {len(asked)}")
        known.append(asked[np.unpackbits(bits, count=n).astype(bool)])
        marks.append(mark)
    return np.concatenate(known), np.concatenate(marks)


def _ask_stretches(search: Search, shards: int) -> Callable:
    def question(table: pa.Table, replies: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        if not replies:
            return
        every = [runs(search, search.texts(texts)) for _, texts in exchange.opened(table, BLOCK)]
        codes, mark = _known_anchors(_code(np.concatenate([found.anchor for found in every]), shards), replies, shards)
        known, bucket = _Lookup(codes), table.column("_bucket")[0].as_py()
        parts: list[tuple[np.ndarray, ...]] = []
        for found, (rows, texts) in zip(every, exchange.opened(table, BLOCK), strict=True):
            there = search.texts(texts)
            rolling = search.rolling(there)
            hit, at = known.find(_code(found.anchor, shards))
            crowded = hit & (mark[at] == 2 if len(mark) else False)
            whole = np.flatnonzero(hit & ~crowded)
            one, one_end = _single(found, np.flatnonzero(crowded))
            first = np.concatenate((found.first[whole], one))
            if not len(first):
                continue
            own = search.own(there, rolling, first, np.concatenate((found.last[whole], one_end)) - 1 + search.window)
            route = np.concatenate((found.anchor[whole], own[len(whole) :])) % _U(shards)
            lone = np.concatenate((np.zeros(len(whole), _U), np.repeat(found.anchor[crowded], (found.last - found.first)[crowded])))
            doc = exchange.doc_ids(rows)[np.searchsorted(there.offsets, first, side="right") - 1]
            order, starts = _firsts(own, doc)
            pick = order[starts]  # each stretch once, in its first document
            parts.append((own[pick], doc[pick], np.diff(np.append(starts, len(order))), lone[pick], route[pick].astype(np.int32)))
        if not parts:
            return
        own, doc, count, lone, route = (np.concatenate(some) for some in zip(*parts, strict=True))
        del parts
        order, starts = _firsts(own, doc)
        pick, total = order[starts], np.add.reduceat(count[order], starts)
        for shard, some in _by_shard(route[pick]):
            mine = pick[some]
            yield shard, bucket, blocks.packed(_steps(own[mine]), _planes(doc[mine]), _planes(total[some]), _planes(lone[mine]))

    return question


#: A block of stretches without their texts: hashes, first documents, counts, and the anchors of single windows.
_ASKED = (np.uint8, np.uint8, np.uint8, np.uint8)


def _stretches(found: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    read = (blocks.unpacked(b, *_ASKED) for b in found)
    return [(_sums(own), _numbers(doc, np.int64), _numbers(count, np.int64), _numbers(lone)) for own, doc, count, lone in read]


def _choose_senders(shard: int, buckets: list[int], found: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Asks the bucket of its first document for the text of each stretch, by half of the stretch's hash."""
    read = _stretches(found)
    own, doc = (np.concatenate([r[i] for r in read]) for i in range(2))
    order, starts = _firsts(own, doc)
    chosen = np.zeros(len(own), bool)
    chosen[order[starts]] = True
    ends = np.cumsum([len(r[0]) for r in read])
    for bucket, r, end in zip(buckets, read, ends, strict=True):
        mine = chosen[end - len(r[0]) : end]
        if mine.any():
            lone = np.unique(r[3][mine])
            yield bucket, blocks.packed(np.sort(r[0][mine].astype(np.uint32)), lone[lone > 0], np.array([shard]))


def _send_texts(search: Search, shards: int) -> Callable:
    """The stretches that a bucket was asked for, and with them a few that share half a hash with one of those."""

    def question(table: pa.Table, replies: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        if not replies:
            return
        read = [blocks.unpacked(b, np.uint32, _U, np.int64) for b in replies]
        wanted = _Lookup(np.concatenate([half.astype(_U) | _U(int(s[0]) << 32) for half, _, s in read]))
        crowded = _Lookup(np.unique(np.concatenate([lone for _, lone, _ in read])))
        bucket = table.column("_bucket")[0].as_py()
        parts: list[tuple[np.ndarray, ...]] = []
        for _, texts in exchange.opened(table, BLOCK):
            there = search.texts(texts)
            found, rolling = runs(search, there), search.rolling(there)

            def asked(first: np.ndarray, last: np.ndarray, route: np.ndarray | None, there=there, rolling=rolling) -> tuple[np.ndarray, ...]:
                end = last - 1 + search.window
                own = search.own(there, rolling, first, end)
                to = (own if route is None else route) % _U(shards)
                use = wanted.find((own & _U(0xFFFFFFFF)) | (to << _U(32)))[0]
                return own[use], to[use], first[use], end[use]

            some = asked(found.first, found.last, found.anchor)
            single = crowded.find(found.anchor)[0]
            if single.any():
                some = tuple(np.concatenate(pair) for pair in zip(some, asked(*_single(found, np.flatnonzero(single)), None), strict=True))
            own, to, first, end = some
            order, starts = _firsts(own)
            if not len(starts):
                continue
            pick = order[starts]
            first, end = first[pick], end[pick]
            # Bytes of the stretch; words are joined by one space.
            if search.by_word:
                lengths = there.ends - there.begins
                laid = np.cumsum(lengths + 1) - lengths - 1
                joined = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
                joined[blocks.spread(laid, lengths)] = there.data[blocks.spread(there.begins, lengths)]
                begin, stop = laid[first], laid[end - 1] + lengths[end - 1]
            else:
                joined, begin, stop = there.data, first, end
            parts.append((own[pick], to[pick].astype(np.int32), stop - begin, joined[blocks.spread(begin, stop - begin)]))
        if not parts:
            return
        own, to, sizes, content = (np.concatenate(some) for some in zip(*parts, strict=True))
        del parts
        order, starts = _firsts(own)
        pick, begin = order[starts], np.cumsum(sizes) - sizes
        for shard, some in _by_shard(to[pick]):
            mine = pick[some]
            yield shard, bucket, blocks.packed(sizes[mine].astype(np.uint32), content[blocks.spread(begin[mine], sizes[mine])], level=5)

    return question


def _known_by(search: Search, sizes: np.ndarray, content: np.ndarray) -> np.ndarray:
    """The hash of each stretch of this text."""
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    texts = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(content))])
    there = search.texts(texts)
    return search.own(there, search.rolling(there), there.offsets[:-1], there.offsets[1:])


#: Gets the pieces' bytes in a row, their sizes, first documents and counts; gives for
#: every window of every piece, in order, the owner (see Search), and windows per piece.
Index = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: The owner of a window that occurs nowhere else.
NOWHERE = (1 << 63) - 1


def _answer_stretches(search: Search, index: Index) -> Callable:
    def reply(shard: int, buckets: list[int], found: list[bytes], sent: list[bytes]) -> Iterator[tuple[int, bytes]]:
        read = _stretches(found)
        own, doc, count = (np.concatenate([r[i] for r in read]) for i in range(3))
        order, starts = _firsts(own, doc)
        which = np.zeros(len(own), np.int64)
        which[order] = np.cumsum(np.concatenate(([0], np.diff(own[order]) != 0)))
        pick = order[starts]
        # The text of each stretch; those that nobody asked for are left.
        texts = [blocks.unpacked(b, np.uint32, np.uint8) for b in sent]
        sizes = np.concatenate([sizes for sizes, _ in texts]).astype(np.int64)
        here, at = _Lookup(np.concatenate([_known_by(search, *some) for some in texts])).find(own[pick])
        if not here.all():
            raise RuntimeError(f"shard {shard} was not sent {int((~here).sum())} stretches")
        begins, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
        distinct = np.concatenate([content for _, content in texts])[blocks.spread(begins, sizes)]
        del texts
        owner, windows = index(distinct, sizes, doc[pick], np.add.reduceat(count[order], starts))
        piece = np.repeat(np.arange(len(pick)), windows)
        at = np.cumsum(windows) - windows
        turns = np.flatnonzero((np.diff(owner) != 0) | (np.diff(piece) != 0)) + 1 if len(owner) else np.zeros(0, np.int64)
        begin = np.concatenate(([0], turns)).astype(np.int64)
        stop = np.append(turns, len(owner))
        use = owner[begin] != NOWHERE
        begin, stop = begin[use], stop[use]
        of_piece = piece[begin]
        first_segment, past_segment = np.searchsorted(of_piece, np.arange(len(pick))), np.searchsorted(of_piece, np.arange(len(pick)), side="right")
        ends = np.cumsum([len(r[0]) for r in read])
        for bucket, r, end in zip(buckets, read, ends, strict=True):
            mine = which[end - len(r[0]) : end]
            n = past_segment[mine] - first_segment[mine]
            if search.earlier:
                # Nothing to tell where the bucket's only holder is the first of all.
                alone = (r[2] == 1) & (n == 1)
                seg = np.minimum(first_segment[mine], max(len(begin) - 1, 0))
                n = np.where(alone & (owner[begin[seg]] >= r[1] if len(begin) else False), 0, n)
            told = n > 0
            if told.any():
                seg = blocks.spread(first_segment[mine][told], n[told])
                shift = at[of_piece[seg]]
                yield bucket, blocks.packed(
                    _steps(r[0][told]), n[told].astype(np.uint32), (begin[seg] - shift).astype(np.uint32), (stop[seg] - shift).astype(np.uint32),
                    _planes(owner[begin[seg]]), _planes(r[3][told]),
                )

    return reply


def removed(
    docs: DataFrame, search: Search, index: Index, finish: Callable[[pa.Table, Texts, np.ndarray], pa.RecordBatch], schema: T.StructType | str,
    carry: list[str] | None = None,
) -> DataFrame:
    """``finish`` gets rows, their texts and the mask of symbols in repeated windows."""
    shards = exchange.pieces(docs)
    buckets = exchange.bucketed(docs, carry)

    def use(table: pa.Table, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        read = [blocks.unpacked(b, np.uint8, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8) for b in replies]
        read = [(_sums(own), *rest, _numbers(owner, np.int64), _numbers(lone)) for own, *rest, owner, lone in read]
        keys, n, begin, stop, owner, lone = (np.concatenate([r[i] for r in read]) if read else np.zeros(0, _U) for i in range(6))
        known, n, crowded = _Lookup(keys), n.astype(np.int64), _Lookup(np.unique(lone[lone > 0]))
        at_segment = np.cumsum(n) - n
        for rows, texts in exchange.opened(table, BLOCK):
            there = search.texts(texts)
            mask = np.zeros(len(there.symbols), bool)
            if len(keys):
                found, rolling = runs(search, there), search.rolling(there)
                hit, at = known.find(search.own(there, rolling, found.first, found.last - 1 + search.window))
                first, at = found.first[hit], at[hit]
                single = ~hit & crowded.find(found.anchor)[0]
                if single.any():
                    # Windows of crowded anchors were asked about one by one.
                    one, one_end = _single(found, np.flatnonzero(single))
                    hit, at_one = known.find(search.own(there, rolling, one, one_end - 1 + search.window))
                    first, at = np.concatenate((first, one[hit])), np.concatenate((at, at_one[hit]))
                seg = blocks.spread(at_segment[at], n[at])
                start = np.repeat(first, n[at])
                low, high = start + begin[seg].astype(np.int64), start + stop[seg].astype(np.int64) - 1 + search.window
                if search.earlier:
                    doc = exchange.doc_ids(rows, NOWHERE if search.none_last else -NOWHERE - 1)[np.searchsorted(there.offsets, start, side="right") - 1]
                    low, high = low[owner[seg] < doc], high[owner[seg] < doc]
                mask = blocks.covered(low, high, len(there.symbols))
            yield finish(rows, there, mask)

    anchors = exchange.answer(exchange.ask(buckets, _ask_anchors(search, shards)), _answer_anchors(search, shards))
    stretches = exchange.ask_again(buckets, anchors, _ask_stretches(search, shards))
    sent = exchange.ask_again(buckets, exchange.answer(stretches, _choose_senders), _send_texts(search, shards))
    return exchange.tell(buckets, exchange.answer_with(stretches, sent, _answer_stretches(search, index)), use, schema)


def kept(there: Texts, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that stay and where each text begins in them; words get one space between."""
    stay = np.flatnonzero(~mask)
    before = np.searchsorted(stay, there.offsets)
    lengths = (there.ends - there.begins)[stay]
    content = there.data[blocks.spread(there.begins[stay], lengths)]
    if not len(stay):
        return content, np.zeros(len(there.offsets), np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return content, ends[before]
