"""Mixing sources to target weights by fitting a budget of words.

Every source gets a target number of words.  Whole passes over the source are
taken first (each document ``target // source_size`` times); what is left of the
target is a budget that a subset of the documents has to meet.  The subset is
chosen by length, not by document: documents are counted by exact length, each
length gives its even share of the budget, and a bounded-knapsack dynamic program
over the lengths fits the rest.  Which documents of a length are taken is decided
by a seeded hash.

Rows: null source is a source of its own, ordered last; null or blank text has
size 0 and is never taken.  Repeated rows are rows of their own.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import blocks
from tidemark.llm.tables import unused, written

#: Budgets above this are first met by even shares; the rest is fitted exactly.
FITTED_BUDGET = 100_000
#: Documents of one length are ranked inside this many hash ranges.
RANGES = 256


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.cut(batches, most=1 << 20):
            _, _, first = blocks.words(*blocks.flat(block.column("text")))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("source"), pa.array(np.diff(first), pa.int64())],
                names=["doc_id", "source", "size"],
            )

    return docs.select("doc_id", "source", "text").mapInArrow(count, "doc_id long, source string, size long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...], most: float = 3.0) -> dict[str | None, float]:
    """Words wanted of each source; the names of sources are few and fit the driver.

    The total of all sizes is shared by weight.  A source is capped at ``most``
    times its size, and what it cannot take is shared again by weight.
    """
    # UTF-8 keeps the order of code points.
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    free, left = set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[n] for n in free)
        full = {n for n in free if left * weight[n] / total >= most * sizes[n]}
        if not full:
            for n in free:
                target[n] = left * weight[n] / total
            break
        for n in full:
            target[n] = most * sizes[n]
        left -= sum(target[n] for n in full)
        free -= full
    return target


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: int, copies: int = 1) -> np.ndarray:
    """How many documents of each length to take so that their sum comes near ``budget``.

    The even shares leave at most one document of each length, which is topped up
    from the long lengths until the rest is small, and the rest is fitted by a
    bounded-knapsack table of reachable sums, in which every document may come up to
    ``copies`` times.  One more document is taken if that comes nearer.
    """
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), np.int64)
    if not total or budget <= 0:
        return taken
    room = counts.astype(np.int64) * copies
    if budget >= total * copies:
        return room
    # Integer shares: the fraction is kept as a ratio of exact numbers.
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((lengths * taken).sum())
    longest_first = np.argsort(-lengths, kind="stable")
    for i in longest_first:
        if left <= FITTED_BUDGET:
            break
        more = min(int(room[i] - taken[i]), (left - FITTED_BUDGET // 2) // int(lengths[i]))
        if more > 0:
            taken[i] += more
            left -= more * int(lengths[i])
    # Reachable sums; via[s] is the length that first reached s, used[s] how many of it.
    usable = [i for i in longest_first if 0 < lengths[i] <= left and room[i] > taken[i]]
    via, used = np.full(left + 1, -1, np.int64), np.zeros(left + 1, np.int64)
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    for i in usable:
        if reached[left]:
            break
        step, before = int(lengths[i]), reached.copy()
        for n in range(1, min(int(room[i] - taken[i]), left // step) + 1):
            moved = np.zeros(left + 1, bool)
            moved[step * n :] = before[: left + 1 - step * n]
            new = moved & ~reached
            if not new.any():
                break
            reached |= new
            via[new], used[new] = i, n
    at = int(np.flatnonzero(reached)[-1])
    left -= at
    while at:
        i = int(via[at])
        taken[i] += used[at]
        at -= int(used[at] * lengths[i])
    above = [i for i in longest_first if left < lengths[i] < 2 * left and room[i] > taken[i]]
    if above:
        taken[above[-1]] += 1
    return taken


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of ``docs``."""
    spark = docs.sparkSession
    # Equal rows differ by their number among the rows of one hash range.
    sizes = written(
        sized(docs).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "size")), "mixing-sizes"
    )
    by_source = {r["source"]: r["n"] or 0 for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    wanted = targets(by_source, weights, most)

    plan = [(s, by_source[s], wanted[s]) for s in by_source]
    # One row per source, held in the plan: Spark knows its size and picks the join.
    shares = spark.createDataFrame(plan, "source string, source_size long, target double")

    def choose(table: pa.Table) -> pa.Table:
        lengths, counts = table.column("size").to_numpy(), table.column("n").to_numpy()
        source_size, target = table.column("source_size")[0].as_py(), table.column("target")[0].as_py()
        whole = int(target // source_size) if source_size else 0
        taken = fitted(lengths, counts, int(round(target - whole * source_size)), int(most) - whole)
        # More than one copy of every document of a length is another whole pass over it.
        passes, picked = whole + taken // counts, taken % counts
        return pa.table(
            {
                "source": table.column("source"),
                "size": table.column("size"),
                "whole": pa.array(passes, pa.int64()),
                "picked": pa.array(picked, pa.int64()),
            }
        )

    histogram = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    # One group per source: its distinct lengths, at most the square root of twice its words.
    chosen = (
        histogram.alias("h")
        .join(shares.alias("s"), F.expr("h.source <=> s.source"))
        .select("h.source", "size", "n", "source_size", "target")
        .groupBy("source")
        .applyInArrow(choose, "source string, size long, whole long, picked long")
        .where("whole > 0 OR picked > 0")
    )
    ranged = sizes.withColumn("range", F.pmod(F.shiftright("draw", 20), F.lit(RANGES)))
    before = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        ranged.where("size > 0")
        .groupBy("source", "size", "range")
        .agg(F.count("*").alias("here"))
        .withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
        .alias("q")
        .join(chosen.alias("c"), F.expr("q.source <=> c.source AND q.size = c.size"))
        .select(
            F.col("q.source").alias("source"), F.col("q.size").alias("size"), "range", "whole",
            F.greatest(F.lit(0), F.least("here", F.col("picked") - F.col("before"))).alias("quota"),
            (F.col("picked") - F.col("before") < F.col("here")).alias("partial"),
        )
        .where("whole > 0 OR quota > 0")
    )
    known = (
        ranged.alias("d")
        .join(quota.alias("q"), F.expr("d.source <=> q.source AND d.size = q.size AND d.range = q.range"), "left")
        .select("d.doc_id", "d.source", "d.size", "d.draw", "d.range", "whole", "quota", "partial")
    )
    inside = Window.partitionBy("source", "size", "range").orderBy("draw", "doc_id")
    edge = known.where("partial AND quota > 0").withColumn("extra", (F.row_number().over(inside) <= F.col("quota")).cast("long"))
    plain = known.where("NOT coalesce(partial AND quota > 0, false)").withColumn(
        "extra", F.when(F.coalesce(F.col("quota"), F.lit(0)) > 0, 1).otherwise(0).cast("long")
    )
    rows = plain.unionByName(edge)
    return rows.alias("r").join(shares.alias("s"), F.expr("r.source <=> s.source")).select(
        "doc_id", "r.source", "size", "source_size", "target",
        (F.col("size") * (F.coalesce("whole", F.lit(0)) + F.col("extra"))).cast("long").alias("taken"),
    )


def repeated(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, columns unchanged, each as often as the mix takes it.

    A document without words, so one with a null text too, is never taken.  Null ids and
    null sources are values like any other; rows that share id, source and number of words
    share what is taken of them in order of their texts; an empty table gives an empty one;
    a text of any length is measured whole; further columns are carried, whatever their names.
    """
    words, copies, alike, nth, times, time = unused(docs.columns, "_size", "_copies", "_rows", "_nth", "_times", "_time")
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema), T.StructField(words, T.LongType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.cut(batches, most=1 << 20):
            _, _, first = blocks.words(*blocks.flat(block.column("text")))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(np.diff(first), pa.int64())], names=schema.names)

    same = ["doc_id", "source", words]
    # Rows that share id, source and size share what is taken of them, in order of their texts.
    # They are read twice below; as a table the plan of the mix is not there twice.
    choice = written(
        mix(docs, weights, most, seed)
        .groupBy("doc_id", "source", "size")
        .agg(F.sum(F.when(F.col("size") > 0, F.expr("taken div size"))).alias(copies), F.count("*").alias(alike))
        .where(F.col(copies) > 0),
        "mixing-choice",
    )
    on = F.expr(f"d.doc_id <=> c.doc_id AND d.source <=> c.source AND d.{words} = c.size")
    found = docs.mapInArrow(measure, schema).alias("d").join(choice.alias("c"), on).select("d.*", copies, alike)
    several = found.where(F.col(alike) > 1).withColumn(nth, F.row_number().over(Window.partitionBy(*same).orderBy("text")))
    counted = (
        found.where(F.col(alike) == 1)
        .withColumn(nth, F.lit(1))
        .unionByName(several)
        .withColumn(times, F.expr(f"{copies} div {alike} + CAST({nth} <= {copies} % {alike} AS INT)").cast("int"))
        .where(F.col(times) > 0)
    )
    return counted.select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias(time)).drop(time)
