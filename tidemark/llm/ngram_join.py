"""Documents whose sets of word n-grams are nearly equal, by a blocked sparse product.

The incidence matrix has a row per distinct set and a column per n-gram.  Two sets
of Jaccard similarity t share at least one of the first n - ceil(t n) + 1 n-grams of
each, whatever the common order; ordering by document frequency (counted over all
documents) leaves few columns with more than one row.  Sets that meet in those columns
form clusters; a cluster is cut into blocks of bounded size, each block of the
matrix is multiplied with its transpose, which adds up the overlap counts, and pairs
below the bound that their sizes set are discarded.  A block hands on only as many
links as it takes to join its components, never all pairs of a group.

Equal sets are one row from the start.  Sets that are near to the same hub (they
share a least hash) are compared with the hub first; pairs inside a component known
by then need no product, so a group of thousands of near copies costs one
comparison each and not one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import blocks, exchange
from tidemark.llm.components import components
from tidemark.llm.tables import unused, written

_U = np.uint64
_SLOTS = 1 << 40
#: Least hashes by which sets find a hub.
STARS = 4
#: Sets of a tile of the matrix; two tiles are multiplied in one task.
TILE = 1500
#: Columns with more rows than this are multiplied densely, so many at a time.
DENSE, COLUMNS = 48, 2048


def shingles(texts: pa.Array, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of every text, ascending, and where each text's begin."""
    data, offsets = blocks.flat(texts)
    starts, ends, first = blocks.words(data, offsets)
    rolling = blocks.Rolling(blocks.word_hashes(data, starts, ends, fold=True, seed=seed), seed)
    n_words = np.diff(first)
    grams = np.where(n_words >= n, n_words - n + 1, np.minimum(n_words, 1))
    begin = blocks.spread(first[:-1], grams)
    doc = np.repeat(np.arange(len(n_words)), grams)
    hashes = rolling.of(begin, np.minimum(begin + n, first[1:][doc]))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(n_words) + 1))


def _ask_frequency(n: int, shards: int, seed: int = 0):
    def question(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
        every = [shingles(texts, n, seed)[0] for _, texts in exchange.opened(table, blocks.BLOCK_BYTES // 4)]
        codes, counts = np.unique(np.concatenate(every) % _U(shards * _SLOTS), return_counts=True)
        bucket, slot, shard = table.column("_bucket")[0].as_py(), codes // _U(shards), (codes % _U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(some):
                yield int(shard[some[0]]), bucket, blocks.packed(slot[some].astype(np.uint32), (slot[some] >> _U(32)).astype(np.uint8), np.minimum(counts[some], 65_535).astype(np.uint16))

    return question


def _answer_frequency(shard: int, buckets: list[int], found: list[bytes]) -> Iterator[tuple[int, bytes]]:
    read = [blocks.unpacked(b, np.uint32, np.uint8, np.uint16) for b in found]
    slot = np.concatenate([low.astype(_U) | (high.astype(_U) << _U(32)) for low, high, _ in read])
    order = np.argsort(slot, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(slot[order]) != 0)))
    total = np.add.reduceat(np.concatenate([c for _, _, c in read]).astype(np.int64)[order], starts)
    # Sixteen steps for every doubling are enough to order by.
    rank = np.where(total > 1, np.minimum(1 + np.log2(total) * 8, 255), 0).astype(np.uint8)
    ranks = np.zeros(len(slot), np.uint8)
    ranks[order] = np.repeat(rank, np.diff(np.append(starts, len(slot))))
    ends = np.cumsum([len(r[0]) for r in read])
    for bucket, (low, high, _), end in zip(buckets, read, ends, strict=True):
        here = ranks[end - len(low) : end]
        hit = here > 0
        if hit.any():
            yield bucket, blocks.packed(low[hit], high[hit], here[hit], np.array([shard], np.int64))


PROFILE = "doc_id long, n long, key binary, grams binary, prefix array<long>, place array<int>, stars array<long>"


def profiles(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: set size, a 128-bit key of the set and, where its first
    n-grams occur in another document, what the join needs of it."""
    shards, seed = exchange.pieces(docs), blocks.fresh_seed()
    buckets = exchange.bucketed(docs)

    def use(table: pa.Table, replies: list[bytes]) -> Iterator[pa.RecordBatch]:
        codes, ranks = [np.zeros(0, _U)], [np.zeros(0, np.uint8)]
        for low, high, rank, shard in (blocks.unpacked(b, np.uint32, np.uint8, np.uint8, np.int64) for b in replies):
            codes.append((low.astype(_U) | (high.astype(_U) << _U(32))) * _U(shards) + _U(shard[0]))
            ranks.append(rank)
        codes, ranks = np.concatenate(codes), np.concatenate(ranks)
        order = np.argsort(codes)
        codes, ranks = codes[order], ranks[order]
        seen: set[bytes] = set()
        for rows, texts in exchange.opened(table, blocks.BLOCK_BYTES // 4):
            hashes, begins = shingles(texts, n, seed)
            sizes = np.diff(begins)
            rank = np.zeros(len(hashes), np.int64)
            if len(codes):
                wanted = hashes % _U(shards * _SLOTS)
                at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
                rank = np.where(codes[at] == wanted, ranks[at], 0).astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            by_rank = np.lexsort((hashes, rank, doc))
            place = np.arange(len(hashes)) - np.repeat(begins[:-1], sizes)
            length = sizes - (percent * sizes + 99) // 100 + 1
            useful = (place < np.repeat(length, sizes)) & (rank[by_rank] > 0)
            ends = np.concatenate(([0], np.cumsum(useful)))[begins]
            prefix, at = hashes[by_rank][useful].view(np.int64), place[useful].astype(np.int32)
            common = rank > 0
            shared, shared_ends = hashes[common], np.concatenate(([0], np.cumsum(common)))[begins]
            safe, empty = np.minimum(begins[:-1], max(len(hashes) - 1, 0)), sizes == 0

            def over(what, values, none=0, safe=safe, empty=empty):
                return np.where(empty, none, what.reduceat(values, safe)) if len(values) else np.full(len(empty), none, values.dtype)

            one, two = over(np.add, blocks.mixed(hashes)), over(np.bitwise_xor, blocks.mixed(hashes + _U(99)))
            stars = np.stack([over(np.minimum, blocks.mixed(hashes ^ _U(0x5151 * (k + 1)))) for k in range(STARS)], axis=1).view(np.int64)
            keys = [None if e else int(n_).to_bytes(4, "big") + a.tobytes() + b.tobytes() for e, n_, a, b in zip(empty, sizes, one, two, strict=True)]
            grams, lists, places, star_lists = [], [], [], []
            for i, key in enumerate(keys):
                if key is None or ends[i + 1] == ends[i] or key in seen:
                    for column in (grams, lists, places, star_lists):
                        column.append(None)
                    continue
                seen.add(key)
                grams.append(shared[shared_ends[i] : shared_ends[i + 1]].tobytes())
                lists.append(prefix[ends[i] : ends[i + 1]])
                places.append(at[ends[i] : ends[i + 1]])
                star_lists.append(stars[i])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(grams, pa.binary()),
                    pa.array(lists, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(star_lists, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "key", "grams", "prefix", "place", "stars"],
            )

    frequencies = exchange.answer(exchange.ask(buckets, _ask_frequency(n, shards, seed)), _answer_frequency)
    return exchange.tell(buckets, frequencies, use, PROFILE)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets really are that similar, compared n-gram by n-gram."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left_grams").to_pylist(), batch.column("right_grams").to_pylist()
            total = (batch.column("left_n").to_numpy() + batch.column("right_n").to_numpy()).tolist()
            keep = []
            for x, y, n in zip(left, right, total, strict=True):
                both = np.concatenate((np.frombuffer(x, _U), np.frombuffer(y, _U)))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (n - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("key").alias("a"), F.col("n").alias("left_n"), F.col("grams").alias("left_grams"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("right_n"), F.col("grams").alias("right_grams"))
    sized = pairs.join(one, "a").join(two, "b")
    fits = F.least("left_n", "right_n") * 100 >= F.greatest("left_n", "right_n") * percent
    return sized.where(fits).select("a", "b", "left_n", "left_grams", "right_n", "right_grams").mapInArrow(compare, "a binary, b binary")


def overlaps(row: np.ndarray, gram: np.ndarray, n_rows: int) -> np.ndarray:
    """The product of a block of the incidence matrix with its transpose, above the diagonal.

    Columns of few rows are multiplied pair by pair, all columns at once; the others
    are laid out densely, a bounded number of them at a time.
    """
    order = np.lexsort((row, gram))
    row, gram = row[order], gram[order]
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(gram)))
    total = np.zeros(n_rows * n_rows, np.float32)
    rare = np.repeat(sizes <= DENSE, sizes)
    few, column = row[rare], np.repeat(np.arange(len(sizes)), sizes)[rare]
    live = np.arange(len(few))
    for step in range(1, DENSE):
        live = live[live + step < len(few)]
        live = live[column[live] == column[live + step]]
        if not len(live):
            break
        total += np.bincount(few[live] * n_rows + few[live + step], minlength=len(total)).astype(np.float32)
    total = total.reshape(n_rows, n_rows)
    common = np.flatnonzero(sizes > DENSE)
    for low in range(0, len(common), COLUMNS):
        some = common[low : low + COLUMNS]
        block = np.zeros((n_rows, len(some)), np.float32)
        block[row[blocks.spread(starts[some], sizes[some])], np.repeat(np.arange(len(some)), sizes[some])] = 1
        total += block @ block.T
    return np.triu(total, 1)


def _product(percent: int):
    """Links between components in one block of sets: as many as it takes to join them."""

    def multiply(table: pa.Table) -> pa.Table:
        found: list[tuple[bytes, bytes]] = []
        table = table.sort_by([("n", "ascending"), ("key", "ascending")])
        keys, n = table.column("key").to_pylist(), table.column("n").to_numpy()
        names, group = np.unique(np.array(table.column("component").to_pylist(), dtype=object), return_inverse=True)
        if len(names) > 1:
            lists = [np.frombuffer(g, _U) for g in table.column("grams").to_pylist()]
            row = np.repeat(np.arange(len(keys)), [len(g) for g in lists])
            shared = overlaps(row, np.concatenate(lists), len(keys))
            linked = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
            x, y = np.nonzero(np.triu(linked, 1) & (group[:, None] != group[None, :]))
            _, once = np.unique(np.minimum(group[x], group[y]) * len(names) + np.maximum(group[x], group[y]), return_index=True)
            root = list(range(len(names)))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i in once.tolist():
                p, q = top(group[x[i]]), top(group[y[i]])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    found.append((keys[x[i]], keys[y[i]]))
        return pa.table([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return multiply


def joined(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) for every row.

    Words are split at ASCII white space, A-Z is folded.  Fewer than ``n`` words are
    one n-gram; a null or blank text has size 0 and is linked with nothing.  Links
    need ``100 * intersection >= percent * union``.  A row without id takes part; a
    component of only such rows has a null id.  Repeated rows get equal results, an
    empty table an empty one; further columns are ignored.
    """
    rows = written(profiles(docs, n, percent), "ngram-profiles")
    sets = written(rows.where("grams IS NOT NULL").dropDuplicates(["key"]).select("key", "n", "grams", "prefix", "place", "stars"), "ngram-sets")
    star = sets.select("key", F.posexplode("stars").alias("k", "star"))
    hubs = star.groupBy("k", "star").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1")
    spokes = star.join(hubs, ["k", "star"]).where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    near = components(_linked(spokes, sets, percent))
    known = written(near, "ngram-near")

    entries = (
        sets.join(known, sets["key"] == known["node"], "left")
        .select("key", "n", F.coalesce("component", "key").alias("component"), F.arrays_zip("prefix", "place").alias("z"))
        .select("key", "n", "component", F.explode("z").alias("z"))
        .select("key", "n", "component", F.col("z.prefix").alias("gram"), F.col("z.place").alias("place"))
    )
    # Columns with rows of one component only have nothing to multiply.
    column = entries.groupBy("gram").agg(F.min("key").alias("least"), F.min("component").alias("x"), F.max("component").alias("y"))
    meeting = entries.join(column.where("x <> y").select("gram", "least"), "gram").select(F.col("key").alias("a"), F.col("least").alias("b"))
    # Sets that meet in a column, directly or through others, are one cluster of the matrix.
    cluster = written(components(meeting), "ngram-clusters")
    tiles = cluster.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("t")).select(F.col("component").alias("cluster"), "t")
    placed = (
        cluster.select(F.col("node").alias("key"), F.col("component").alias("cluster"))
        .join(tiles, "cluster")
        .withColumn("own", F.pmod(F.xxhash64("key"), "t").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
        .select("key", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    member_of = sets.select("key", "n", "grams").alias("s").join(known.alias("k"), F.expr("s.key = k.node"), "left").select("s.*", F.coalesce("component", "key").alias("component"))
    crossing = written(
        placed.join(member_of, "key").groupBy("cluster", "i", "j").applyInArrow(_product(percent), "a binary, b binary"), "ngram-links"
    )
    every = known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(crossing.select("a", "b"))
    final = components(every) if not crossing.isEmpty() else known
    member = rows.select("doc_id", "n", "key").alias("r").join(final.alias("f"), F.expr("r.key = f.node"), "left").select(
        "doc_id", "n", F.coalesce("f.component", "r.key").alias("component")
    )
    least = member.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return member.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs``, columns unchanged, of which each component keeps its least id.

    Of rows with the same id one stays, the first by its text; rows without id all stay, and
    so do null and blank texts, which are linked with nothing.  An empty table gives an empty
    one; a text of any length is compared whole; further columns are carried, whatever their
    names.
    """
    (nth,) = unused(docs.columns, "_nth")
    found = joined(docs, n, percent).select("doc_id", "component_id")
    # A table of its own, or the plan below would hold the whole join three times.
    keep = written(found.where("doc_id = component_id").select("doc_id").distinct(), "ngram-kept")
    numbered = docs.where("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi")
    repeated = numbered.groupBy("doc_id").agg(F.count("*").alias("_copies")).where("_copies > 1").select("doc_id")
    once = numbered.join(repeated, "doc_id", "left_anti")
    first = Window.partitionBy("doc_id").orderBy("text")
    again = numbered.join(repeated, "doc_id", "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)
