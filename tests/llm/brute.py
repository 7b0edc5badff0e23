"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None, fold: bool = False) -> list[str]:
    text = text or ""
    if fold:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def late(doc_id: int | None) -> tuple:
    return (doc_id is None, doc_id or 0)


def suffix_dedup(rows, window=50):
    first: dict[bytes, tuple] = {}
    for d, t in sorted(rows, key=lambda r: late(r[0])):
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], late(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < late(d):
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def substring_dedup(rows, window=35):
    seen: Counter = Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [0] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [1] * window
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, n=3):
    w = words(text, fold=True)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def components(rows, n=3, percent=90):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                root[top(i)] = top(j)
    ids: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return [(d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)]


def base_scores(rows):
    tokens = [[*words(t, fold=True), None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    seen: Counter = Counter()
    for w, h in zip(tokens, held, strict=True):
        if not h:
            seen.update(w)
    n, v = sum(seen.values()), len(seen)
    return [
        (d, h, len(w), sum(seen[x] > 0 for x in w), n, sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w))
        for (d, _), w, h in zip(rows, tokens, held, strict=True)
    ]
