"""Operators against brute force, on rows with every awkward case."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import (
    blocks, components, fm_index, language_model, licenses, mixing, neighbours, ngram_join, packing, quality, repeats, sketch, suffixes,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def awkward_rows():
    """Nulls, empties, copies, near copies, repeats inside a text, ties, clashing ids, a long text."""
    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 6))) for _ in range(400)] + ["Ünï", "日本語", "ÉCOLE"]
    say = lambda n: " ".join(draw.choices(vocabulary, k=n))
    base, passage = say(120), say(60)
    near = base.split()
    near[7] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, say(50) + " " + passage + "\n" + say(20)), (5, say(10) + " " + passage), (6, None), (7, ""),
        (8, " \t\n "), (9, "one"), (10, "one two"), (11, "One TWO"), (12, "und " * 90), (13, say(30) + " der" * 70 + " x y z" * 40), (14, say(9000)),
        (None, base), (None, None), (15, passage), (15, passage), (16, "a" * 300), (17, "  　 <|endoftext|> x"), (-5, say(40) + " " + passage),
    ]
    near_group = say(200).split()
    for i in range(60):
        some = list(near_group)
        some[i] = f"edit{i}"
        some[100 + i] = f"edit{i}b"
        rows.append((100 + i, " ".join(some)))
    return [(d, t, "en", [None, "s1", "s2", "s10"][i % 4], None if t is None else len(t)) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with names that operators use themselves.
    frame = spark.createDataFrame(awkward_rows(), SCHEMA)
    return frame.withColumn("size", F.lit("x")).withColumn("key", F.lit(1)).withColumn("bucket", F.lit(2)).repartition(5)


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in awkward_rows()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def collected(frame):
    return ordered(tuple(r) for r in frame.collect())


def test_suffix_arrays_match_sorting():
    draw = np.random.default_rng(1)
    for n in range(1, 60):
        text = np.append(draw.integers(1, 2 + n % 4, n), 0).astype(np.uint8)
        expected = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        order = suffixes.suffix_array(text, 256)
        assert order.tolist() == expected == suffixes.doubled(text.astype(np.int64)).tolist()
        shared = suffixes.common_prefixes(text, order)
        for one, two in zip(order[:-1], order[1:], strict=True):
            a, b = text[one:].tolist(), text[two:].tolist()
            assert shared[two] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_suffix_dedup(docs, pairs, empty):
    assert collected(suffixes.deduplicated(docs, with_kept=False).drop("kept")) == ordered(brute.suffix_dedup(pairs))
    kept = {r["doc_id"]: r["kept"] for r in suffixes.deduplicated(docs.where("doc_id < 6")).collect()}
    assert bytes(kept[2]) == b"" and bytes(kept[1]).decode() == pairs[0][1]
    assert not suffixes.deduplicated(empty).collect()


def test_substring_dedup(docs, pairs, empty):
    assert collected(fm_index.deduplicated(docs, with_kept=False).drop("kept")) == ordered(brute.substring_dedup(pairs))
    assert not fm_index.deduplicated(empty).collect()


def test_crowded_anchors_are_searched_window_by_window(docs, pairs):
    search, index = fm_index._search(35, 8)
    crowded = repeats.Search(35, 8, by_word=True, earlier=False, crowded=2)

    def finish(rows, there, mask):
        gone = np.concatenate(([0], np.cumsum(mask)))
        return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array(np.diff(gone[there.offsets]))], names=["doc_id", "n"])

    found = repeats.removed(docs, crowded, index, finish, "doc_id long, n long")
    assert collected(found) == ordered((r[0], r[2]) for r in brute.substring_dedup(pairs))


def test_matching_statistics():
    draw = np.random.default_rng(3)
    for _ in range(40):
        parts = [draw.integers(2, 5, draw.integers(1, 12)).tolist() for _ in range(draw.integers(1, 5))]
        text = np.array(sum(([*p, 1] for p in parts), []) + [0])
        index = fm_index.FMIndex(text, (text > 1).astype(int), 6)
        sizes = np.array([len(p) for p in parts])
        found = index.matching(np.array(sum(parts, [])), np.cumsum(sizes), sizes).tolist()
        count = lambda s: sum(p[i : i + len(s)] == s for p in parts for i in range(len(p) - len(s) + 1))  # noqa: E731, B023
        expected = [max(n for n in range(len(p) - i + 1) if not n or count(p[i : i + n]) > 1) for p in parts for i in range(len(p))]
        assert found == expected


def test_ngram_join(docs, pairs, empty):
    assert collected(ngram_join.joined(docs)) == ordered(brute.components(pairs))
    assert collected(ngram_join.joined(docs, n=5, percent=80)) == ordered(brute.components(pairs, 5, 80))
    assert not ngram_join.joined(empty).collect()


def test_one_of_each_near_copy_stays(docs, pairs):
    kept = ngram_join.one_of_each(docs, n=5, percent=80)
    expected = {d for d, _, c in brute.components(pairs, 5, 80) if d is not None and d == c}
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(expected)
    assert ids.count(None) == 2


def test_block_products_count_overlaps():
    draw = np.random.default_rng(8)
    sets = [np.unique(draw.integers(0, 300, 80)) for _ in range(90)]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found = ngram_join.overlaps(row, np.concatenate(sets).astype(np.uint64), len(sets))
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(90) for j in range(i + 1, 90))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    found = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_fingerprints(docs, pairs, empty):
    rows = sorted(((d, t or "") for d, t in pairs if d is not None))
    found = {}
    for r in sketch.fingerprints(docs.where("doc_id IS NOT NULL")).collect():
        found.setdefault((r["doc_id"], r["edited_sha256"]), r)
    for i, (d, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        row = found[(d, hashlib.sha256(edited.encode()).hexdigest())]
        assert row["n_chars"] == len(text)
        assert 0 <= row["near_next"] <= 1 and 0 <= row["near_edited"] <= 1
        if len(text) > 2000:
            grams = lambda s: {s.encode()[k : k + 8] for k in range(len(s.encode()) - 7)}
            exact = len(grams(text) & grams(edited)) / len(grams(text) | grams(edited))
            assert abs(exact - row["near_edited"]) < 0.1
    by_text = {}
    for d, text in rows:
        by_text.setdefault(text, set()).update(r["fingerprint"] for (k, _), r in found.items() if k == d and d != 15)
    assert all(len(prints) <= 1 for prints in by_text.values())
    assert sketch.fingerprints(docs).count() == len(pairs)
    assert not sketch.fingerprints(empty).collect()


def test_containment_of_unequal_texts():
    draw = random.Random(2)
    whole = "".join(draw.choices("abcdefghij ", k=40_000))
    prints = sketch.Sketches(*blocks.flat(pa.array([whole, whole[5_000:9_000], "x" * 3]))).strings()
    assert sketch.containment(prints[1], prints[0]) > 0.95
    assert sketch.containment(prints[0], prints[1]) < 0.2


def test_mix(docs, pairs, empty):
    rows = mixing.mix(docs).collect()
    sizes = {}
    for r, (_, _, _, source, _) in zip(range(len(pairs)), awkward_rows(), strict=True):
        sizes[source] = sizes.get(source, 0) + len(brute.words(pairs[r][1]))
    assert len(rows) == len(pairs)
    expected = mixing.targets(sizes, (5, 2, 1))
    assert sum(expected.values()) == pytest.approx(sum(sizes.values()))
    for source in sizes:
        mine = [r for r in rows if r["source"] == source]
        assert {r["source_size"] for r in mine} == {sizes[source]}
        assert mine[0]["target"] == pytest.approx(expected[source])
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - expected[source]) <= 12 + 0.05 * expected[source]
    again = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert not mixing.mix(empty).collect()
    taken = sum(r["taken"] for r in rows)
    repeated = mixing.repeated(docs)
    assert repeated.columns == docs.columns
    assert sum(len(brute.words(r["text"])) for r in repeated.collect()) == taken


def test_targets_are_capped_and_shared_again():
    found = mixing.targets({"a": 10, "b": 1000, None: 1000}, (5, 2, 1))
    assert found["a"] == 30 and found["b"] == pytest.approx(1980 * 2 / 3) and found[None] == pytest.approx(1980 / 3)


def test_budgets_are_fitted_exactly():
    draw = np.random.default_rng(6)
    for copies in (1, 2, 3) * 20:
        lengths = np.unique(draw.integers(1, 40, 6))
        counts = draw.integers(1, 5, len(lengths))
        budget = int(draw.integers(0, (lengths * counts).sum() + 1))
        taken = mixing.fitted(lengths, counts, budget, copies)
        assert (taken >= 0).all() and (taken <= counts * copies).all()
        assert abs(int((taken * lengths).sum()) - budget) <= int(lengths.max())
    assert mixing.fitted(np.array([9000]), np.array([1]), 8546, 3).tolist() == [1]
    assert (mixing.fitted(np.array([7, 3, 9000]), np.array([5, 2, 1]), 100, 3) * [7, 3, 9000]).sum() == 100


def test_packing(docs, pairs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    frame = packing.packed(docs).toPandas()
    by_doc = {}
    for piece in frame.itertuples():
        by_doc.setdefault(None if np.isnan(piece.doc_id) else int(piece.doc_id), []).append(piece)
    for d, text in pairs:
        if d is None or d == 15:
            continue
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for piece in sorted(by_doc[d], key=lambda p: p.start):
            assert piece.start == at and piece.doc_tokens == len(ids)
            assert piece.ids_crc32 == zlib.crc32(ids[at : at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)
    lengths = frame.groupby("sequence_id").length.sum()
    ends = (frame.offset + frame.length).groupby(frame.sequence_id).max()
    assert (lengths == ends).all() and lengths.max() <= 2048
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths) <= 0.05 * lengths.sum()
    assert not packing.packed(empty).collect()


def test_bm25_prefers_documents_that_share_rare_terms():
    ids = np.array([5, 6, 7, 8, 9, 9, 5, 6, 7, 3, 2, 2, 8, 8], np.uint16)
    rarity = np.ones(1 << 16)
    index = packing.Index(ids, np.array([0, 4, 6, 10, 14]), rarity, 4.0)
    assert index.like(0, np.array([False, True, True, True])).tolist()[0] == 2


def test_windows_take_every_neighbour_before_unrelated_documents():
    # 100 short documents share a term with the seed, 100 longer ones do not.
    like = [np.array([50, 60 + i % 7, 1]) for i in range(100)]
    other = [np.array([200, 201, 202, 203, 1]) for _ in range(100)]
    texts = [np.array([50, 51, 52, 53, 54, 55, 1]), *like, *other]
    sizes = np.array([len(t) for t in texts])
    index = packing.Index(np.concatenate(texts).astype(np.uint16), np.concatenate(([0], np.cumsum(sizes))), np.ones(1 << 16), float(sizes.mean()))
    assert sorted(index.like(0, np.arange(201) > 0).tolist()) == list(range(1, 101))
    assert {doc for doc, _, _ in packing.filled(sizes, index, 256)[0]} <= set(range(101))


def test_a_seed_asks_with_all_its_terms():
    ids = np.array([*range(10, 70), 1, 10, 1, 69, 1], np.uint16)
    index = packing.Index(ids, np.array([0, 61, 63, 65]), np.ones(1 << 16), 20.0)
    assert sorted(index.like(0, np.array([False, True, True])).tolist()) == [1, 2]


def test_documents_of_one_subject_meet_in_a_shard(spark):
    draw = random.Random(9)
    subjects = [["".join(draw.choices("bcdfghklmnprst", k=6)) for _ in range(6)] for _ in range(40)]
    rows = [(i, " ".join(draw.choices(subjects[i % 40], k=40))) for i in range(800)]
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), window=1024).collect()
    shards = {}
    for p in pieces:
        shards.setdefault(p["doc_id"] % 40, []).append(p["sequence_id"] >> 40)
    same = sum(max(map(s.count, set(s))) for s in shards.values())
    assert same >= 0.6 * len(pieces)


def test_crowded_cells_are_dealt_over_shards():
    found = packing.dealt({(1, -1): 10, (2, 0): 100, (2, 1): 10, (3, -1): 40}, 16)
    assert found[2, 0] == (1, 10) and found[1, -1] == (0, 1) and all(a + n <= 16 for a, n in found.values())


def test_license_scan(spark, docs, empty):
    texts = {n: t for n, t in licenses.TEMPLATES.items()}
    changed = texts["MIT"].replace("Software", "Program", 2).replace("without limitation ", "")
    rows = [(1, "word " * 50 + texts["GPL-3.0 notice"] + " tail"), (2, f"{changed}\nmore"), (3, "license text of another kind"), (4, None), (5, ""), (None, texts["MIT notice"])]
    rows.append((6, "x " * 3000 + texts["Apache-2.0 header"] + " y" * 10 + texts["Apache-2.0 header"]))
    found = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = ordered((r["doc_id"], r["license"]) for r in found)
    assert (1, "GPL-3.0 notice") in names and (2, "MIT") in names and (None, "MIT notice") in names
    assert names.count((6, "Apache-2.0 header")) == 2 and not [n for n in names if n[0] in (3, 4, 5)]
    by_id = dict(rows)
    for r in found:
        assert by_id[r["doc_id"]][r["start_char"] : r["end_char"]] == r["passage"]
        assert r["coverage"] == pytest.approx(r["matched_words"] / r["template_words"])
    assert 0.9 < next(r["coverage"] for r in found if r["license"] == "MIT") < 1
    assert not licenses.scanned(docs.limit(3), {}).collect() and not licenses.scanned(empty).collect()


def test_short_notices_with_one_changed_word_are_found(spark):
    texts = ["Released under an MIT License", "Released under MIT License", "so Released under the big MIT License it is", "a license under the sun"]
    found = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    hits = {r["doc_id"]: r["matched_words"] for r in found if r["license"] == "MIT notice"}
    assert hits == {0: 4, 1: 4, 2: 5}


def test_templates_hold_whole_licenses():
    assert licenses.TEMPLATES["BSD-2-Clause"].endswith("POSSIBILITY OF SUCH DAMAGE.")
    assert licenses.TEMPLATES["ISC"].endswith("PERFORMANCE OF THIS SOFTWARE.") and "https://unlicense.org" in licenses.TEMPLATES["Unlicense"]


def test_nearest_neighbours(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = neighbours.nearest(vectors, "vec_id % 50 = 0").collect()
    rows = vectors.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in ids[ids % 50 == 0]:
        near = unit @ unit[ids == q][0]
        near[ids == q] = -9
        best = ids[np.lexsort((ids, -near))[:5]]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(near[ids == v][0] - s) < 1e-12 for _, v, s in mine)
        hits += len(set(best) & {m[1] for m in mine})
    assert hits / len(found) >= 0.9


def test_vectors_that_take_no_part_and_ties(spark):
    bad = [(2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [])]
    good = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (1, [0.0, 1.0])] + [(100 + i, [1.0, 0.0]) for i in range(20)]
    frame = spark.createDataFrame(bad + good, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("v", F.lit("x"))
    found = collected(neighbours.nearest(frame, "vec_id % 50 = 0").select("query_id", "rank", "vec_id"))
    assert found[:5] == [(0, 1, 5), (0, 2, 50), (0, 3, 100), (0, 4, 101), (0, 5, 102)]
    assert [f for f in found if f[0] == 100] == [(100, 1, 0), (100, 2, 5), (100, 3, 50), (100, 4, 101), (100, 5, 102)]
    assert not neighbours.nearest(frame.where("false"), "vec_id % 50 = 0").collect()
    few = neighbours.nearest(frame.where("vec_id IN (0, 1)"), "vec_id = 0").collect()
    assert [tuple(r)[:3] for r in few] == [(0, 1, 1)]


def test_language_model_counts_and_scores(docs, pairs, empty):
    found = ordered(tuple(r)[:6] for r in language_model.scored(docs).collect())
    expected = ordered(brute.base_scores(pairs))
    for one, two in zip(found, expected, strict=True):
        assert one[:5] == two[:5] and one[5] == pytest.approx(two[5], rel=1e-9)
    assert not language_model.scored(empty).collect()


def test_windows_score_every_id_once():
    sizes = np.array([1, 31, 32, 33, 100, 0, 5])
    at, inside, scored = language_model.windows(sizes)
    places = at[:, language_model.CONTEXT :][scored]
    assert sorted(places.tolist()) == list(range(int(sizes.sum())))


def test_window_batches_agree_with_one_window_and_never_look_ahead():
    draw = np.random.default_rng(0)
    classes = language_model.Classes.of_counts(draw.integers(0, 50, 300).astype(float))
    pairs_ = language_model.paired(draw.integers(0, 5, (language_model.CLASSES + 1, language_model.CLASSES)), classes)
    p = language_model.fresh(pairs_)
    p["out"] *= 10
    ids, sizes = draw.integers(0, 300, 150), np.array([70, 80])
    whole = language_model.log_probabilities(p, classes, ids, sizes, batch=2)
    assert np.allclose(whole, language_model.log_probabilities(p, classes, ids, sizes, batch=64), atol=1e-5)
    assert np.allclose(whole[70:], language_model.log_probabilities(p, classes, ids[70:], sizes[1:]), atol=1e-5)
    changed = ids.copy()
    changed[60:70] = 7
    assert np.allclose(whole[:60], language_model.log_probabilities(p, classes, changed, sizes)[:60], atol=1e-5)


def test_training_lowers_the_loss():
    draw = np.random.default_rng(1)
    sizes = np.array([400] * 20)
    ids = np.tile(np.arange(8), 1000)
    ids[draw.random(8000) < 0.05] = 3
    classes = language_model.Classes.of_counts(np.bincount(ids, minlength=300).astype(float))
    p = language_model.fresh(language_model.paired(np.zeros((language_model.CLASSES + 1, language_model.CLASSES)), classes))
    before = language_model.log_probabilities(p, classes, ids, sizes).mean()
    for turn in range(3):
        p = language_model.trained(p, classes.of[ids], sizes, 0.01, turn)
    assert language_model.log_probabilities(p, classes, ids, sizes).mean() > before + 0.5


def test_the_model_learns_from_every_training_document(docs, monkeypatch):
    seen, fit = [], language_model.fit
    monkeypatch.setattr(language_model, "fit", lambda tokens, *more: seen.append(tokens) or fit(tokens, *more))
    found = language_model.scored(docs).collect()
    sizes = [blocks.unpacked(r["z"], np.uint16, np.int64)[1] for r in seen[0].collect()]
    assert sorted(np.concatenate(sizes).tolist()) == sorted(r["n_ids"] for r in found if not r["held_out"])


def test_rounds_share_out_all_windows(monkeypatch):
    draw = np.random.default_rng(2)
    sizes = np.array([1, 400, 33, 70])
    classes = draw.integers(0, language_model.CLASSES, int(sizes.sum()))
    used = []
    monkeypatch.setattr(language_model, "gradient", lambda p, read, inside, scored, target: used.extend(target[scored].tolist()) or (0.0, {}))
    p = language_model.fresh(np.zeros((language_model.CLASSES + 1, language_model.CLASSES), np.float32))
    for turn in range(language_model.ROUNDS):
        language_model.trained(p, classes, sizes, 0.01, turn)
    assert sorted(used) == sorted(classes.tolist())


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    ratings = quality.ratings_of(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    model = quality.fit(docs, ratings.where("doc_id % 5 <> 0"), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    held = quality.graded(docs, model).join(ratings.where("doc_id % 5 = 0"), "doc_id")
    counts = {(r["grade"], r["keep"]): r["count"] for r in held.groupBy("grade", "keep").count().collect()}
    share = lambda g, k: counts.get((g, k), 0) / max(counts.get((g, k), 0) + counts.get((g, not k), 0), 1)
    assert share(2, True) > 0.96 and share(0, False) > 0.8 and share(1, False) > 0.8


def test_quality_of_awkward_rows(spark, docs, pairs, empty):
    ratings = spark.createDataFrame([(1, 2), (12, 0), (12, 1), (None, 1), (999, 0), (13, None)], "doc_id long, grade int")
    model = quality.fit(docs, ratings, 3)
    rows = quality.graded(docs, model).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert len(r["tail"]) == 2 and r["tail"][0] >= r["tail"][1] and r["expected_grade"] == pytest.approx(sum(r["tail"]))
    kept = quality.selected(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in rows)
    none = quality.fit(docs, ratings.where("false"), 3)
    assert quality.selected(docs, none).count() == len(pairs)
    assert not quality.graded(empty, model).collect()
