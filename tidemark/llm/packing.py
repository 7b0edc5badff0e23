"""Packing documents into fixed windows with their lexical neighbours.

Documents are cut into token ids once and dealt into shards by content: documents with
the same most telling term meet, and what crowds one term is split by a min-hash of the
terms, so that copies still meet.  A shard builds a BM25 inverted index of its documents (document frequencies are those of the whole
corpus), and fills one window after the other: a seed document, then the unused
documents most like it, the last of them cut where the window is full.  What is cut
off stays in the index.  Full windows of a long document stand alone.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks, exchange
from tidemark.llm.tables import written

END_ID = 1
#: Of so many best neighbours those that fit whole go before one that has to be cut.
NEIGHBOURS = 32
#: Words a worker remembers the ids of; beyond that it starts afresh. Those met twice it keeps for the next task.
REMEMBERED = 1_000_000
K1, B = 1.2, 0.75
#: Parts by min-hash of the documents of a term that one shard cannot hold.
PARTS = 256
#: Ids whose keys are worked out at once.
KEYED_IDS = 1 << 20
#: Seeds that a shard scores at a time, and cells of its matrix of common terms.
AHEAD, COLUMN_CELLS = 32, 6 << 20
#: Stands between words asked about in one text.
MARK = b"|"
#: A min-hash value for every term.
TERM_HASHES = blocks.mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))
#: Bytes that separate, letters, digits, signs, and what stays with its neighbours.
KIND = np.full(256, 4, np.uint8)
KIND[33:127] = 3
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = 1
KIND[[ord(c) for c in "'<|>"]] = 4
KIND[blocks.SPACE] = 0
#: Whether two kinds that stand side by side are one piece.
JOINED = np.array([a > 0 and b > 0 and (4 in (a, b) or (a == b and a != 2)) for a in range(5) for b in range(5)])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts, word by word: the tokenizers used never join across white space.

    ``lead`` goes before every word, ``end`` is the id after every text, and ``fold``
    makes A-Z small.  ``fine`` is for tokenizers that also keep ASCII letters, digits and
    signs apart and make letters small: they are asked about such pieces, of which far
    fewer differ than of words.
    """

    def __init__(self, path: str, end: int = END_ID, lead: str = "", fold: bool = False, fine: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.end, self.lead, self.fold, self.fine = path, end, lead, fold, fine
        self._tokenizer = None
        sign = self._asked([lead + MARK.decode()])[0]
        #: The id of the sign between words that are asked about together, if it is one id.
        self.mark = sign[0] if len(sign) == 1 else None
        self._forget()

    @property
    def tokenizer(self):
        """Read from its file when it is needed."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            if self.fold:
                self._tokenizer.encode_special_tokens = True
        return self._tokenizer

    def rest(self) -> None:
        """Lets go of the tokenizer and of the words that were met once: idle workers keep what they hold."""
        self._tokenizer = None
        often = self.met > 1
        places = blocks.spread(self.starts[often].astype(np.int64), self.sizes[often].astype(np.int64))
        self.known, self.ids, self.sizes = self.known[often], self.ids[places], self.sizes[often]
        self.starts = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes).astype(np.int32)
        # What the next task does not meet is let go then.
        self.met = np.ones(len(self.known), np.uint8)
        blocks.give_back()

    def _asked(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        # Hashes ascending, where the ids of each begin and how many they are, and in how many blocks it was met.
        self.known, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.met = np.zeros(0, np.uint16), np.zeros(0, np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and where each begins."""
        data, offsets = blocks.flat(texts)
        if self.fold:
            data = blocks.FOLD[data]
        if self.fine:
            starts, ends, first = pieces(data, offsets)
            data = _small(data, starts, ends)
        else:
            starts, ends, first = blocks.words(data, offsets)
        hashes, where, number = np.unique(blocks.word_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self._forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        self.met[at[~new]] |= 2
        if new.any():
            whole, which = data.tobytes(), where[new]
            ids, sizes = self.of_words([whole[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            known = np.concatenate((self.known, hashes[new]))
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.starts = np.concatenate((self.starts, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)))[order]
            self.sizes, self.ids = np.concatenate((self.sizes, sizes.astype(np.int32)))[order], np.concatenate((self.ids, ids))
            self.met = np.concatenate((self.met, np.ones(len(sizes), np.uint8)))[order]
            at = np.searchsorted(self.known, hashes)
        ids, begins, _ = laid_out(self.ids, self.starts[at].astype(np.int64)[number], self.sizes[at].astype(np.int64)[number], first, self.end)
        return ids, begins

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and how many each has; many words are asked about in one text."""
        alone = [MARK in w or self.mark is None for w in words]
        together, parts, sizes = [w for w, a in zip(words, alone, strict=True) if not a], [], []
        for low in range(0, len(together), 200 * 64):
            some = together[low : low + 200 * 64]
            texts = [self.lead + (b" " + MARK + b" ").join(some[i : i + 200]).decode() + " " + MARK.decode() for i in range(0, len(some), 200)]
            ids = np.concatenate([np.array(a, np.uint16) for a in self._asked(texts)])
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(some):
                raise ValueError("the tokenizer does not keep words apart at white space")
            parts.append(np.delete(ids, marks))
            sizes.append(np.diff(np.concatenate(([-1], marks))) - 1)
        single = [np.array(a, np.uint16) for a in self._asked([self.lead + w.decode() for w, a in zip(words, alone, strict=True) if a])]
        ids = np.concatenate([np.zeros(0, np.uint16), *parts, *single])
        size = np.concatenate([np.zeros(0, np.int64), *sizes, np.array([len(a) for a in single], np.int64)])
        # Back to the order of ``words``.
        order = np.argsort(np.argsort(np.array(alone), kind="stable"), kind="stable")
        begin = np.cumsum(size) - size
        return ids[blocks.spread(begin[order], size[order])], size[order]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``blocks.words``, cut between ASCII letters, digits and signs too, digits one by one.

    Other bytes, apostrophes and what special tokens are written with stay with what
    stands beside them.
    """
    kind = KIND[data]
    joined = np.zeros(len(data) + 1, bool)
    joined[1:-1] = JOINED[kind[:-1] * np.uint8(5) + kind[1:]] if len(data) else False
    joined[offsets] = False
    solid = kind > 0
    starts, ends = np.flatnonzero(solid & ~joined[:-1]), np.flatnonzero(solid & ~joined[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _small(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A-Z made small, but not in pieces that may hold a special token, which is written in one way."""
    small = blocks.FOLD[data]
    signs = np.flatnonzero(data == ord("<"))
    if len(signs):
        some = np.unique(np.searchsorted(starts, signs, side="right") - 1)
        places = blocks.spread(starts[some], ends[some] - starts[some])
        small[places] = data[places]
    return small


def laid_out(every: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of texts from those of their words, which are stretches of ``every``.

    Every text's ids are followed by the end id.  Also returns where texts and where
    words begin.
    """
    laid = np.concatenate(([0], np.cumsum(size)))
    begins = laid[first] + np.arange(len(first))
    out = np.full(int(laid[-1]) + len(first) - 1, end, np.uint16)
    places = laid[:-1] + np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[blocks.spread(places, size)] = every[blocks.spread(begin, size)]
    return out, begins, places


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, **settings) -> Encoder:
    """One per worker and setting, so that words are remembered from task to task."""
    key = (path, *sorted(settings.items()))
    if key not in _encoders:
        _encoders[key] = Encoder(path, **settings)
    return _encoders[key]


def _distinct(ids: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, their ids once each, ascending, and how often; a stretch of documents at a time."""
    low, n = 0, len(begins) - 1
    while low < n:
        high = min(max(low + 1, int(np.searchsorted(begins, begins[low] + KEYED_IDS, side="right")) - 1), low + (1 << 16), n)
        doc = np.repeat(np.arange(high - low, dtype=np.uint32), np.diff(begins[low : high + 1]))
        pairs = (doc << np.uint32(16)) | ids[begins[low] : begins[high]]
        pairs.sort()
        starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        found = pairs[starts]
        yield (found >> np.uint32(16)).astype(np.int32) + np.int32(low), found.astype(np.uint16), np.diff(np.append(starts, len(pairs))).astype(np.int32)
        low = high


def content_order(frequency: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Terms, most telling first, and the place of each in that order.

    A document's most telling term is the rarest that at least ``least`` documents hold;
    where no term is so frequent it is the most frequent one.
    """
    term = np.arange(len(frequency))
    # The end id, which all hold, comes last.
    order = np.lexsort((term, np.where(frequency >= least, frequency, -frequency), frequency < least, term == END_ID))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return order, place


def content_keys(ids: np.ndarray, begins: np.ndarray, order: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's most telling term, and a part by min-hash of its terms."""
    first = np.minimum.reduceat(place[ids], begins[:-1])
    return order[first], (np.minimum.reduceat(TERM_HASHES[ids], begins[:-1]) % np.uint64(PARTS)).astype(np.int64)


def dealt(cells: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], tuple[int, int]]:
    """The first shard of each (term, part), and how many shards share it.

    ``cells`` has the weight of each.  They are laid in a row and cut into equal shards;
    a cell larger than a shard is dealt over several.
    """
    target, before, out = max(sum(cells.values()) / shards, 1e-9), 0, {}
    for cell in sorted(cells):
        first = min(int(before / target), shards - 1)
        out[cell] = first, max(1, min(round(cells[cell] / target), shards - first))
        before += cells[cell]
    return out


class Index:
    """BM25 weights of one shard's documents by term.

    Weights are whole 64ths, so sums do not depend on their order.  Terms that many of
    the documents hold are columns of a matrix, the others lists; seeds are asked for
    several at a time, and documents that are used up are dropped from both.
    """

    def __init__(self, ids: np.ndarray, begins: np.ndarray, rarity: np.ndarray, mean: float):
        n = len(begins) - 1
        length = np.diff(begins)
        docs, terms, weights = [np.zeros(0, np.int32)], [np.zeros(0, np.uint16)], [np.zeros(0, np.float32)]
        for doc, term, counts in _distinct(ids, begins):
            weight = rarity[term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length[doc] / mean))
            asked = term != END_ID
            docs.append(doc[asked])
            terms.append(term[asked])
            weights.append(np.maximum(np.round(weight[asked] * 64), 1).astype(np.float32))
        doc, self.query_terms, weight = np.concatenate(docs), np.concatenate(terms), np.concatenate(weights)
        del docs, terms, weights
        # A document's query: all its terms.
        self.queries = np.searchsorted(doc, np.arange(n + 1))
        held = np.bincount(self.query_terms, minlength=len(rarity))
        common = np.flatnonzero(held > n / 16)
        common = common[np.argsort(-held[common], kind="stable")][: max(1, min(1024, COLUMN_CELLS // max(n, 1)))]
        self.column = np.full(len(rarity), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((n, len(common)), np.float32)
        column = self.column[self.query_terms]
        dense = column >= 0
        self.matrix[doc[dense], column[dense]] = weight[dense]
        doc, term, weight = doc[~dense], self.query_terms[~dense], weight[~dense]
        by_term = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by_term], weight[by_term]
        self.terms = np.searchsorted(term[by_term], np.arange(len(rarity) + 1))
        self.listed, self.scores = np.arange(n), {}

    def _drop(self, unused: np.ndarray) -> None:
        keep = unused[self.listed]
        if 4 * keep.sum() > 3 * len(keep):
            return
        number, stays = np.cumsum(keep, dtype=np.int32) - 1, keep[self.doc]
        self.listed, self.matrix = self.listed[keep], self.matrix[keep]
        self.terms = np.concatenate(([0], np.cumsum(stays)))[self.terms]
        self.doc, self.weight = number[self.doc[stays]], self.weight[stays]

    def _score(self, seeds: np.ndarray, unused: np.ndarray) -> None:
        """Works out what each of ``seeds`` has in common with every unused document."""
        self._drop(unused)
        asked, lists = np.zeros((len(seeds), self.matrix.shape[1]), np.float32), []
        for at, seed in enumerate(seeds.tolist()):
            terms = self.query_terms[self.queries[seed] : self.queries[seed + 1]]
            column = self.column[terms]
            asked[at, column[column >= 0]] = 1
            rare = terms[column < 0].astype(np.int64)
            places = blocks.spread(self.terms[rare], self.terms[rare + 1] - self.terms[rare])
            lists.append(np.bincount(self.doc[places], self.weight[places], minlength=len(self.listed)))
        score = asked @ self.matrix.T
        self.scores = {seed: score[at] + lists[at].astype(np.float32) for at, seed in enumerate(seeds.tolist())}

    def like(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All unused documents that share a term with ``seed``, best first."""
        return np.fromiter(self.ranked(seed, unused), np.int64)

    def ranked(self, seed: int, unused: np.ndarray, ahead: np.ndarray | None = None) -> Iterator[int]:
        """All unused documents that share a term with ``seed``, best first, ties by number.

        ``ahead`` are the seeds that are likely to be asked for next.
        """
        if seed not in self.scores:
            more = np.zeros(0, np.int64) if ahead is None else ahead[(ahead != seed) & unused[ahead]]
            self._score(np.append(seed, more[:AHEAD]), unused)
        score = np.where(unused[self.listed], self.scores.pop(seed), np.float32(0))
        best = np.flatnonzero(score)
        if len(best) > 4 * NEIGHBOURS:
            # Most windows are full long before the last of these.
            bound = np.partition(score[best], len(best) - 2 * NEIGHBOURS)[len(best) - 2 * NEIGHBOURS]
            top = best[score[best] >= bound]
            yield from self.listed[top[np.argsort(-score[top], kind="stable")]].tolist()
            best = best[score[best] < bound]
        yield from self.listed[best[np.argsort(-score[best], kind="stable")]].tolist()


def filled(sizes: np.ndarray, index: Index | None, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length), every one but the last few full.

    The tokens left at the end fill sequences whose lengths are powers of two.
    """
    out: list[list[tuple[int, int, int]]] = []
    start = (sizes // window) * window
    for i in np.flatnonzero(sizes >= window):
        out += [[(int(i), s, window)] for s in range(0, int(start[i]), window)]
    left = sizes - start
    seeds, nxt = np.lexsort((np.arange(len(sizes)), -left)), 0
    while True:
        while nxt < len(seeds) and not left[seeds[nxt]]:
            nxt += 1
        if nxt == len(seeds):
            break
        seed = int(seeds[nxt])
        row, room = [], window

        def take(i: int, most: int, row: list = row) -> int:
            length = min(int(left[i]), most)
            row.append((i, int(start[i]), length))
            start[i] += length
            left[i] -= length
            return length

        room -= take(seed, room)
        if room:
            cuttable = -1
            for rank, i in enumerate(index.ranked(seed, left > 0, seeds[nxt : nxt + 4 * AHEAD]) if index else []):
                if rank >= NEIGHBOURS and cuttable >= 0:
                    break
                if left[i] <= room:
                    room -= take(i, room)
                    if not room:
                        break
                elif cuttable < 0:
                    cuttable = i
            if room and cuttable >= 0 and left[cuttable]:
                room -= take(cuttable, room)
            # Nothing else shares a term with the seed: the next seeds fill what is left.
            ahead = nxt
            while room and ahead < len(seeds):
                if left[seeds[ahead]]:
                    room -= take(int(seeds[ahead]), room)
                else:
                    ahead += 1
        out.append(row)
        if room:
            out.pop()
            out += _powers(row)
    return out


def _powers(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A short sequence as sequences of lengths that are powers of two."""
    total, out, pieces = sum(p[2] for p in row), [], list(row)
    for bit in range(total.bit_length() - 1, -1, -1):
        want, part = total & (1 << bit), []
        while want:
            doc, start, length = pieces.pop(0)
            used = min(length, want)
            part.append((doc, start, used))
            want -= used
            if used < length:
                pieces.insert(0, (doc, start + used, length - used))
        if part:
            out.append(part)
    return out


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, window: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is a file of the ``tokenizers`` library that the workers can read; it
    must keep words apart at ASCII white space and have fewer than 65,536 ids.

    Rows: a null or empty text is the end id alone; a null or repeated id is a
    document of its own; an empty table gives an empty result; further columns are
    ignored.  Runs agree: shards follow from contents and ids, order inside them from
    ids and lengths and contents.
    """
    path, fine = tokenizer or default_tokenizer(), tokenizer is None
    spark, shards = docs.sparkSession, exchange.pieces(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, press, names = encoder(path, fine=fine), zstandard.ZstdCompressor(level=1), ["doc_id", "n", "z", "df", "n_docs"]
        vocabulary = coder.tokenizer.get_vocab_size()
        frequency, n_docs = np.zeros(vocabulary, np.int64), 0
        # Encodings take far more memory than their texts.
        for block in blocks.cut(batches, most=1 << 20):
            ids, begins = coder.encode(block.column("text"))
            for _, terms, _ in _distinct(ids, begins):
                frequency += np.bincount(terms, minlength=vocabulary)
            n_docs += block.num_rows
            raw, cuts = ids.tobytes(), (begins * 2).tolist()
            n, rows = np.diff(begins), block.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"), pa.array(n, pa.int64()),
                    pa.array([press.compress(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.int64()),
                ],
                names=names,
            )
        coder.rest()
        if n_docs:
            one = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*one, pa.array([frequency.tobytes()], pa.binary()), pa.array([n_docs])], names=names)

    tokens = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n long, z binary, df binary, n_docs long"), "tokens"
    )

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n_docs = None, 0
        for batch in batches:
            for blob, n in zip(batch.column("df").to_pylist(), batch.column("n_docs").to_pylist(), strict=True):
                part = np.frombuffer(blob, np.int64)
                total, n_docs = part if total is None else total + part, n_docs + n
        if total is not None:
            term = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1)), pa.array(np.append(total[term], n_docs))], names=["term", "n"])

    # The vocabulary bounds this: one number for each of its ids, and the documents as -1.
    known = tokens.where("df IS NOT NULL").select("df", "n_docs").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = np.zeros(1 << 16)
    by_term = {r["term"]: r["n"] for r in known.collect()}
    n_docs = by_term.pop(-1, 0)
    for term, n in by_term.items():
        frequency[term] = n
    rarity = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))
    mean = float(tokens.agg(F.avg("n")).first()[0] or 1.0)

    # A term that fewer documents hold than a part of a shard would tear its subject apart.
    order, place = content_order(frequency, max(2.0, n_docs / shards / 8))

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        spread, parts = zstandard.ZstdDecompressor(), []
        begins = np.concatenate(([0], np.cumsum(batch.column("n").to_numpy())))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(begins, begins[low] + KEYED_IDS, side="right")) - 1)
            ids = np.frombuffer(b"".join(spread.decompress(z) for z in batch.column("z").slice(low, high - low).to_pylist()), np.uint16)
            parts.append(content_keys(ids, begins[low : high + 1] - begins[low], order, place))
            low = high
        return np.concatenate([t for t, _ in parts]), np.concatenate([p for _, p in parts])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << 16) * PARTS, np.int64)
        for batch in batches:
            if batch.num_rows:
                term, part = keys(batch)
                np.add.at(total, term * PARTS + part, batch.column("n").to_numpy() + int(mean))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "w"])

    whole = tokens.where("z IS NOT NULL").select("doc_id", "n", "z")
    cells = whole.select("n", "z").mapInArrow(weigh, "at long, w long").groupBy("at").agg(F.sum("w").alias("w"))
    cells = cells.select(F.expr(f"at div {PARTS}").alias("term"), F.expr(f"at % {PARTS}").alias("part"), "w")
    # A row for each term, and for each part of those that one shard cannot hold: as many as the vocabulary and the shards bound.
    by_cell = {(r["term"], -1): r["w"] for r in cells.groupBy("term").agg(F.sum("w").alias("w")).collect()}
    target = sum(by_cell.values()) / shards
    crowded = [term for (term, _), w in by_cell.items() if w > target]
    for r in cells.where(F.col("term").isin(crowded)).collect() if crowded else []:
        by_cell[r["term"], r["part"]] = r["w"]
    for term in crowded:
        del by_cell[term, -1]
    first, over = (np.zeros((1 << 16, PARTS), np.int32) for _ in range(2))
    for (term, part), (shard, n) in dealt(by_cell, shards).items():
        first[term, slice(None) if part < 0 else part], over[term, slice(None) if part < 0 else part] = shard, n
    held = np.flatnonzero(over.any(axis=1))
    row_of = np.zeros(1 << 16, np.int64)
    row_of[held] = np.arange(len(held))
    first, over = (z if len(held) else np.zeros((1, PARTS), np.int32) for z in (first[held], over[held]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                term, part = keys(batch)
                # What crowds one cell is dealt on by ids and lengths.
                ids = batch.column("doc_id").fill_null(-1).to_numpy().astype(np.uint64)
                among = blocks.mixed(blocks.mixed(ids) + batch.column("n").to_numpy().astype(np.uint64))
                shard = first[row_of[term], part] + (among % over[row_of[term], part].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *batch.columns], names=["shard", "doc_id", "n", "z"])

    def pack(table: pa.Table) -> pa.Table:
        spread, number = zstandard.ZstdDecompressor(), table.column("shard")[0].as_py()
        rows = [(d is None, d or 0, n, spread.decompress(z)) for d, n, z in zip(*(table.column(c).to_pylist() for c in ("doc_id", "n", "z")), strict=True)]
        rows.sort()
        ids = np.frombuffer(b"".join(r[3] for r in rows), np.uint16)
        sizes = np.array([r[2] for r in rows], np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes)))
        out: list[tuple] = []
        for at, sequence in enumerate(filled(sizes, Index(ids, begins, rarity, mean), window)):
            offset = 0
            for doc, start, length in sequence:
                low = int(begins[doc]) + start
                out.append((None if rows[doc][0] else rows[doc][1], start, length, zlib.crc32(ids[low : low + length].astype("<u4")), int(sizes[doc]), (number << 40) | at, offset))
                offset += length
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        blocks.give_back()
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return whole.mapInArrow(deal, "shard int, doc_id long, n long, z binary").groupBy("shard").applyInArrow(pack, OUT)
