"""Connected components of a table of links, by alternating large and small stars.

Each task first hangs the nodes of the links it reads, a bounded number at a time, on the
least node they reach by those links.  Where few tasks hold all links that leaves nothing
for the stars to do; a round of them is several shuffles, and the plans of many rounds are
what the driver's memory goes to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import written

#: Links of a task that are hung on their least nodes at once.
LINKS = 200_000


def least_reached(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least of the nodes 0 .. n - 1 that each of them reaches by the links x - y."""
    top = np.arange(n)
    while True:
        one, two = top[x], top[y]
        apart = one != two
        if not apart.any():
            return top
        x, y, one, two = x[apart], y[apart], one[apart], two[apart]
        np.minimum.at(top, np.maximum(one, two), np.minimum(one, two))
        while ((further := top[top]) != top).any():
            top = further


def _hung(links: DataFrame) -> DataFrame:
    """Links that join the same nodes: of those a task reads together, stars around the least."""

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= LINKS:
                yield from stars(held)
                held, n = [], 0
        if n:
            yield from stars(held)

    def stars(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks().dictionary_encode()
        # Bytes and numbers sort here as they do in Spark.
        order = pc.array_sort_indices(ends.dictionary)
        nodes, place = ends.dictionary.take(order), np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        x, y = np.split(place[ends.indices.to_numpy()], 2)
        top = least_reached(x, y, len(nodes))
        hanging = np.flatnonzero(top != np.arange(len(top)))
        yield from pa.table([nodes.take(pa.array(hanging)), nodes.take(pa.array(top[hanging]))], names=["a", "b"]).to_batches()

    kind = links.schema["a"].dataType.simpleString()
    return links.select("a", "b").where("a <> b").mapInArrow(hang, f"a {kind}, b {kind}").distinct()


def _starred(links: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of every node (the smaller ones, or the larger ones) on the least.

    The least neighbour is a grouped minimum joined back, so a node with very many
    links is never one group in memory.
    """
    near = links.where("a <> b")
    if small:
        near = near.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = near.select(F.col("a").alias("u"), F.col("b").alias("v")).union(near.select(F.col("b"), F.col("a")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    back = near.join(least, "u")
    if small:
        moved = back.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        moved = back.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and none that hangs bears others."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("bears")).union(
        links.select("b", F.lit(0), F.lit(1))
    )
    node = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("bears").alias("bears"))
    return not node.where("hangs > 1 OR hangs = 1 AND bears = 1").agg(F.count("*")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its least node."""
    now = written(_hung(links), "links")
    while not _settled(now):
        now = written(_hung(_starred(_starred(now, small=False), small=True)), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b"), F.col("b"))
    ).distinct()
