"""Vector codes, spelling variants and sharding against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import sidebyside
from tidemark.llm import queries, sharding, spelling, vector_codes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_spelling_variants"])
def test_same_rows_as_sql(spark, name):
    assert sidebyside.difference(queries.queries()[name](spark, SF), SF, queries.oracle_sql()[name]) is None


# Vector codes


def test_equal_average_search_is_exact_and_prunes():
    draw = np.random.default_rng(5)
    for _ in range(120):
        dimension, entries = int(draw.integers(1, 9)), int(draw.integers(1, 17))
        book, rows = draw.integers(-4, 4, (entries, dimension)), draw.integers(-6, 6, (200, dimension))
        index, distance, _ = vector_codes.EqualAverage(book).nearest(rows)
        full = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
        assert index.tolist() == full.argmin(axis=1).tolist() and distance.tolist() == full.min(axis=1).tolist()
    book, rows = np.arange(256).reshape(-1, 1) * 10, draw.integers(0, 2560, (1000, 1))
    assert vector_codes.EqualAverage(book).nearest(rows)[2] < 4 * len(rows)


VECTORS = "vec_id long, embedding array<double>, label int, code string, error int"


def awkward_vectors():
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(16)], [None, 0, 1][i % 3]) for i in range(3, 90)]
    rows += [(1, None, 0), (2, [0.0] * 15 + [None], 0), (100, [math.nan] * 16, 1), (101, [math.inf] * 16, 1)]
    rows += [(102, rows[0][1], None), (103, rows[0][1], 1), (103, rows[0][1], 1), (None, rows[5][1], 2)]
    return [(*r, "x", 7) for r in rows]


def brute_codes(rows, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * x) for x in r[1]] for r in kept]
    size = len(whole[0]) // 8
    parts = [[v[p * size : (p + 1) * size] for v in whole] for p in range(8)]
    books = [[list(x) for x in mine[:entries]] for mine in parts]

    def assign(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            groups = defaultdict(list)
            for x in parts[p]:
                groups[assign(books[p], x)[1]].append(x)
            for e, found in groups.items():
                books[p][e] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    last = [[assign(books[p], parts[p][i]) for p in range(8)] for i in range(len(kept))]
    out = [(r[0], r[2], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(kept, last, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return out, digest


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("n_rows", [95, 9])
def test_codes_of_awkward_vectors(spark, n_rows):
    rows = awkward_vectors()[-n_rows:]
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    books = vector_codes.train(frame)
    expected, digest = brute_codes(rows)
    assert books.sha256() == digest
    found = vector_codes.encoded(frame, books, ["vec_id", "label"]).collect()
    assert order(tuple(r) for r in found) == order(expected)
    for r in found[:5]:
        vector = next(v for i, v, *_ in rows if i == r["vec_id"])
        near = books.decoded(r["code"])
        assert r["error"] == sum((math.floor(4096 * a) - round(4096 * b)) ** 2 for a, b in zip(vector, near, strict=True))


def test_vectors_that_cannot_be_cut_or_measured(spark):
    frame = spark.createDataFrame([(1, [1.0] * 8), (2, [2.0] * 16), (3, [1e30] * 8), (4, [3.0] * 8)], "vec_id long, embedding array<double>")
    found = vector_codes.encoded(frame, vector_codes.train(frame), ["vec_id"])
    assert {r["vec_id"]: r["code"] for r in found.collect()} == {1: "00" * 8, 2: None, 3: None, 4: "01" * 8}
    odd = spark.createDataFrame([(1, [1.0] * 9)], "vec_id long, embedding array<double>")
    assert vector_codes.train(odd) is None
    assert [tuple(r) for r in vector_codes.encoded(odd, None, ["vec_id"]).collect()] == [(1, None, None)]
    assert vector_codes.train(frame.where("false")) is None


# Spelling variants


def edits(word, letters):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
    return found - {word}


def brute_pairs(words):
    known, letters = set(words), sorted(set("".join(words)))
    return {(w, v) for w in known for v in edits(w, letters) & known}


def test_acceptors_are_minimal_and_compose():
    words = sorted({"aab", "aabb", "ab", "abb", "b", "bab", "bb", "cab", "cabs"})
    acceptor = spelling.Acceptor(words)
    assert {frozenset(p) for p in acceptor.pairs("")} == {frozenset(p) for p in brute_pairs(words)}
    assert len(list(acceptor.pairs(""))) == len(brute_pairs(words)) // 2
    alike = [a + b for a in "abcd" for b in ("xyz", "xz")]
    used = {0}
    grown = spelling.Acceptor(alike)
    for arcs in grown.arcs:
        used |= set(arcs.values())
    assert len(used) == 5


@pytest.mark.parametrize(("crowded", "part_words"), [(4000, 20_000), (6, 10), (1, 5)])
def test_pairs_whatever_is_crowded(spark, monkeypatch, crowded, part_words):
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    monkeypatch.setattr(spelling, "PART_WORDS", part_words)
    draw = random.Random(9)
    words = {"".join(draw.choices("ab", k=draw.randint(1, 8))) for _ in range(150)}
    words |= {"aaaaaa" + "".join(draw.choices("abéÿ", k=draw.randint(0, 3))) + "bbbbbb" for _ in range(60)}
    words |= {"q" * 300, "q" * 301, "q" * 150 + "r" + "q" * 150}
    frame = spark.createDataFrame([(w, len(w)) for w in sorted(words)], "word string, n long")
    found = [(r["word"], r["near"]) for r in spelling.near_pairs(frame).collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_pairs(sorted(words))


def brute_variants(rows, shortest=6, least=5, one_in=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least}
    near = defaultdict(list)
    for w, v in brute_pairs(sorted(counts)):
        near[w].append((-counts[v], v))
    form = {w: min(near[w])[1] for w in counts if near[w] and -min(near[w])[0] >= 5 * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def test_variants(spark):
    draw = random.Random(1)
    say = lambda w, n: [w] * n
    pool = say("Morning", 700) + say("mornings", 130) + say("morninga", 5) + say("mornin", 25) + say("école-pédant", 30) + say("ECOLES", 9)
    pool += say("évidence", 6) + say("évidance", 30) + say("×÷×÷×÷", 5) + say("short", 50) + say("naïveté", 4) + say("zzzzzzzz", 6)
    draw.shuffle(pool)
    rows = [(i, " ".join(pool[i::40])) for i in range(40)] + [(None, "evening " * 60), (None, None), (50, ""), (50, "evenings " * 12), (50, "evenings,evenings")]
    rows.append((60, "日本語 " + "w" * 5000 + " middle " * 3000 + " middles"))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x")).repartition(4)
    for one_in in (199, 3):
        found = [tuple(r) for r in spelling.variants(frame, one_in=one_in).collect()]
        assert order(found) == order(brute_variants(rows, one_in=one_in))
        assert any(r[1] for r in found)
    roots = {r[0]: r[2] for r in spelling.variants(frame, one_in=10**12).collect()}
    assert roots["morninga"] == "morning"
    assert not spelling.variants(frame.where("false")).collect()


# Sharding


def test_communication_matrix_has_the_exact_sums_and_law():
    draw = np.random.default_rng(2)
    for sizes in ([5, 100, 0, 33, 1], [1] * 20, [0], []):
        columns = sharding.shard_sizes(sum(sizes), 16)
        rows = list(sharding.matrix(draw, sizes, columns))
        assert [sum(r) for r in rows] == sizes
        assert [sum(c) for c in zip(*rows, strict=True)] == (columns if rows else [])
        assert max(columns) - min(columns) <= 1
    # Against the exact probabilities of a small urn.
    n, good, total = 6, 7, 15
    seen = Counter(sharding.drawn(draw, good, total, n) for _ in range(30_000))
    for k in range(n + 1):
        chance = math.comb(good, k) * math.comb(total - good, n - k) / math.comb(total, n)
        assert abs(seen[k] / 30_000 - chance) < 0.012
    # Populations that do not fit the usual generators.
    wide = [sharding.drawn(draw, 10**13, 4 * 10**13, 10**6) for _ in range(200)]
    assert abs(np.mean(wide) - 250_000) < 150 and 330 < np.std(wide) < 540


SHARDED = "doc_id long, text string, shard string, part int, rank int"


def test_shards_are_whole_even_and_uniform(spark):
    rows = [(i, f"text {i}", "s", 1, 2) for i in range(60)] + [(7, "text 7", "s", 1, 2), (None, None, None, None, None), (61, "", "s", 3, 4), (62, "é" * 9999, "s", 1, 1)]
    frame = spark.createDataFrame(rows, SHARDED).repartition(5)
    found = sharding.shuffled(frame, shards=6).collect()
    assert Counter((r["doc_id"], r["text"], r["part"], r["rank"]) for r in found) == Counter((r[0], r[1], r[3], r[4]) for r in rows)
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r["slot"])
    assert sorted(len(s) for s in by_shard.values()) == sorted(sharding.shard_sizes(64, 6))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert not sharding.shuffled(frame.where("false")).collect()
    assert sorted((r["shard"], r["slot"]) for r in sharding.shuffled(frame.limit(2), shards=6).collect()) == [(0, 0), (1, 0)]
    # Over many seeds every row is everywhere equally often, and pairs meet as often as they should.
    together, first = 0, Counter()
    small = spark.range(8).repartition(3).cache()
    for seed in range(40):
        at = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shuffled(small, shards=2, seed=seed).collect()}
        first[at[3]] += 1
        together += sum(at[a][0] == at[b][0] for a, b in combinations(range(8), 2))
    assert abs(together / 40 - 12) < 1e-9
    assert len(first) >= 6 and max(first.values()) <= 14


def test_ranges_of_a_shard_join_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    monkeypatch.setattr(sharding, "CHUNK", 3)
    found = sharding.shuffled(spark.range(0, 500, 1, 3), shards=4).collect()
    assert Counter(r["shard"] for r in found) == {s: 125 for s in range(4)}
    for s in range(4):
        mine = sorted((r["slot"], r["id"]) for r in found if r["shard"] == s)
        assert [m[0] for m in mine] == list(range(125))
        assert abs(np.corrcoef(range(125), [m[1] for m in mine])[0, 1]) < 0.35


def test_digests_and_written_shards(spark, tmp_path):
    rows = [(1, "é"), (2, None), (3, ""), (4, "abc")]
    frame = sharding.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in frame.collect()}
    assert found == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    sharding.write_shards(sharding.shuffled(frame, shards=2), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["shard"], r["slot"]) for r in back.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_sharding_query_counts_every_document(spark):
    found = queries.op13_uniform_shards(spark, SF)
    counts = [r["n"] for r in found.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == spark.read.parquet(f"{SF}/documents.parquet").count() and max(counts) - min(counts) <= 1
    assert {r["law"] for r in found.select("law").distinct().collect()} == {"rows"}
