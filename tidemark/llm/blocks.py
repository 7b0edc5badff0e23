"""Texts as flat numpy arrays: cutting batches, finding words, rolling hashes.

All functions work on one block of whole texts at a time.  A block holds a few
megabytes, so memory stays bounded whatever the number of rows in an Arrow batch;
one text longer than that is a block of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_RANDOM = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and the same with A-Z folded to a-z.
BYTE_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Only some C libraries can be asked to give memory back.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Longer words are hashed by a digest: where a pattern doubles often enough, whatever the
#: factor, its powers cancel.
LONG = 64

#: Bytes whose words are hashed at once.
HASHED_BYTES = 1 << 18

_powers: dict[tuple[str, int], np.ndarray] = {}


def fresh_seed() -> int:
    """A seed for the hashes of one job.

    Nobody can know beforehand which texts such hashes confuse.  Seed 0 stands for fixed
    hashes, for results that are made of them.
    """
    return secrets.randbits(62) + 1


@lru_cache(maxsize=4)
def _drawn(seed: int) -> tuple[np.ndarray, int]:
    if not seed:
        return BYTE_VALUE, _BASE
    draw = np.random.default_rng(seed).integers(0, 1 << 64, 257, dtype=np.uint64)
    # As of the fixed one, the powers of a factor that is 5 modulo 8 differ by few twos.
    return draw[:256] | _U(1), int(draw[256]) & ~7 | 5


def byte_values(seed: int = 0) -> np.ndarray:
    """The symbol of each byte."""
    return _drawn(seed)[0]


def _power(kind: str, n: int, seed: int) -> np.ndarray:
    have = _powers.get((kind, seed))
    if have is None or len(have) < n:
        for other in [k for k in _powers if k[1] != seed]:
            del _powers[other]
        size = max(-(-n // (1 << 17)), 1) << 17
        factor = _drawn(seed)[1]
        steps = np.full(size, factor if kind == "up" else pow(factor, -1, 1 << 64), _U)
        steps[0] = 1
        _powers[kind, seed] = have = np.cumprod(steps)
    return have[:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = values ^ (values >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, seed: int = 0):
        total = np.zeros(len(symbols) + 1, _U)
        np.cumsum(symbols * _power("up", len(symbols), seed), out=total[1:])
        self.total, self.seed = total, seed

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.total[ends] - self.total[starts]) * _power("down", len(self.total), self.seed)[starts]
        return mixed(raw + (ends - starts).astype(_U))

    def windows(self, k: int) -> np.ndarray:
        """The hash of every k symbols in a row; empty if there are fewer."""
        n = len(self.total) - k
        if n <= 0:
            return np.zeros(0, _U)
        return mixed((self.total[k:] - self.total[:n]) * _power("down", n, self.seed) + _U(k))


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    wide = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if wide == pa.large_binary() else "")
    texts = texts.cast(wide)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of about ``most`` bytes of text, never splitting a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``[^\\x20\\x09-\\x0D]`` and each text's first word.

    The third array has one entry per text and a last one for the total.  ``gaps``
    may name other bytes that separate words.
    """
    solid = ~gaps[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] |= solid[edges]
    closes[edges - 1] |= solid[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, seed: int = 0) -> np.ndarray:
    """A hash for each of the words, which follow each other in ``data``."""
    values = byte_values(seed)[FOLD] if fold else byte_values(seed)
    hashes, low = np.empty(len(starts), _U), 0
    while low < len(starts):
        # The hashes of a stretch take eight bytes for each of its own several times over.
        begin = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, begin + HASHED_BYTES, side="right")))
        part = Rolling(values[data[begin : int(ends[high - 1])]], seed)
        hashes[low:high] = part.of(starts[low:high] - begin, ends[low:high] - begin)
        low = high
    if not (ends - starts > LONG).any():
        return hashes
    return digested(hashes, FOLD[data] if fold else data, starts, ends, seed, LONG)


def digested(hashes: np.ndarray, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, most: int) -> np.ndarray:
    """``hashes`` of stretches of ``symbols``, but of those of more than ``most`` a digest."""
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(ends - starts > most).tolist():
        digest = hashlib.blake2b(symbols[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes


def owners(offsets: np.ndarray) -> np.ndarray:
    """For every symbol the text it lies in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first, lengths) + np.repeat(starts, lengths)


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on for the stages that follow,
    and what it keeps they cannot have."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in at least one of the half-open stretches."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def packed(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value; ``unpacked`` reads them back given their types."""
    import zstandard

    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), level)


def unpacked(value: bytes, *types: type) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(value)
    sizes, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for kind, n in zip(types, sizes, strict=True):
        kind = np.dtype(kind)
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += kind.itemsize * int(n)
    return out
