"""A uniform shuffle into shards of exact sizes.

The rows of every input partition are dealt to the shards by a communication
matrix: entry (partition, shard) says how many rows go from the one to the other.
Its rows add up to the partitions' sizes and its columns to the shards' sizes, and
it is drawn from the multivariate hypergeometric law, which is the law of these
counts under a uniform permutation of all rows.  Every partition is permuted and
cut by its row of the matrix, the pieces are exchanged, and every shard is permuted
again.  All orders of all rows are then equally likely, and the sizes of the shards
are exact from the start: at most one apart.

Rows: repeated rows are rows of their own, and equal texts are dealt as independently
as unequal ones; a row of nulls is a row.  Fewer rows than shards leave the last
shards empty; an empty table gives an empty result.  Columns named shard or slot
are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import written
from tidemark.session import dimension, small

#: An input partition longer than 2**CHUNK rows counts as several.
CHUNK = 20
#: A shard is permuted in ranges of about so many rows.
RANGE_ROWS = 200_000


def drawn(random: np.random.Generator, good: int, total: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``total`` without replacement are among ``good``.

    Inverts the exact distribution from its ratios of neighbouring probabilities,
    twelve deviations and forty counts around the mode; what lies outside has a
    probability no double can tell from 0.  No bound on the size of the population.
    """
    least, most = max(0, n - (total - good)), min(n, good)
    if least == most:
        return least
    mode = (n + 1) * (good + 1) // (total + 2)
    deviation = math.sqrt(n * (good / total) * ((total - good) / total) * ((total - n) / max(total - 1, 1)))
    side = int(12 * deviation) + 40
    k = np.arange(max(least, mode - side), min(most, mode + side) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[1:]) - np.log(total - good - n + k[1:])
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    chance = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(chance, random.random() * chance[-1], side="right"), len(k) - 1)])


def matrix(random: np.random.Generator, rows: Iterable[int], columns: list[int]) -> Iterable[list[int]]:
    """The communication matrix row by row, for given sums of its rows and columns."""
    room = list(columns)
    for n in rows:
        total, left, counts = sum(room), n, []
        for good in room:
            x = drawn(random, good, total, left)
            counts.append(x)
            total, left = total - good, left - x
        room = [r - x for r, x in zip(room, counts, strict=True)]
        yield counts


def shard_sizes(n_rows: int, shards: int) -> list[int]:
    return [n_rows // shards + (s < n_rows % shards) for s in range(shards)]


def shuffled(rows: DataFrame, shards: int = 16, seed: int = 13) -> DataFrame:
    """The columns of ``rows``, shard (from 0) and slot (the place in the shard, from 0).

    The driver holds one number per partition and shard, never a row.  Where the
    pieces go is fixed by a written table, so a lost executor changes nothing.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    # The id's upper bits tell the partition, cut into chunks.
    dealt = written(
        rows.select(F.struct(*names).alias("row"), F.monotonically_increasing_id().alias("id"))
        .withColumn("part", F.shiftright("id", CHUNK)), "shuffle-rows",
    )
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())
    n_rows = sum(n for _, n in sizes)
    drawn_rows = matrix(np.random.default_rng(seed), (n for _, n in sizes), shard_sizes(n_rows, shards))
    cuts = dimension(
        spark,
        [{"part": p, "ends": np.cumsum(c).tolist()} for (p, _), c in zip(sizes, drawn_rows, strict=True)],
        pa.schema([("part", pa.int64()), ("ends", pa.list_(pa.int64()))]),
    )
    ranges = max(1, -(-n_rows // (shards * RANGE_ROWS)))
    inside = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    exchanged = written(
        dealt.withColumn("rank", F.row_number().over(inside))
        .join(small(cuts, len(sizes)), "part")
        .select(
            "row", "id", F.xxhash64(F.lit(seed + 1), "id").alias("draw"),
            F.size(F.filter("ends", lambda end: end < F.col("rank"))).alias("shard"),
        )
        .withColumn("range", F.pmod(F.shiftright("draw", 24), F.lit(ranges)).cast("int")),
        "shuffle-exchanged",
    )
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = exchanged.groupBy("shard", "range").agg(F.count("*").alias("n")).select(
        "shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")
    )
    again = Window.partitionBy("shard", "range").orderBy("draw", "id")
    return (
        exchanged.withColumn("nth", F.row_number().over(again))
        .join(small(begins, shards * ranges), ["shard", "range"])
        .select("row.*", "shard", (F.col("begin") + F.col("nth") - 1).alias("slot"))
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes of the text and one more) and text_crc32 (a null text: of nothing)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )


def write_shards(shuffled_rows: DataFrame, path: str) -> None:
    """One folder per shard, its files in order of slots; a shard is written by several
    tasks, each a range of slots."""
    rows = shuffled_rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
