"""Questions from buckets of documents to shards of keys, and the answers back.

Many operators need to know something about every small piece of every text (how
often does it occur, and where first) without sending the pieces around as rows.
Documents are dealt once into buckets.  A bucket sends each shard of the key
space one compressed block of distinct keys; the shard answers each bucket with
one block.  A key that a third of all documents hold is sent once per bucket, not
once per document, and both sides hold only one bucket or shard at a time.  The
exchange of the documents is the same plan each time it is used, so Spark runs it
once and reuses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import blocks
from tidemark.llm.tables import parts

ASKED = "_shard int, _bucket int, _blob binary"
ANSWERED = "_bucket int, _blob binary"

#: Shards per shuffle partition; there is one bucket.  Few, because there is a block
#: for each bucket and shard, and a shard's index has to fit a task.
PER_PARTITION = 2


def pieces(docs: DataFrame) -> int:
    """The number of shards."""
    return PER_PARTITION * parts(docs.sparkSession)


def bucketed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """_bucket, the carried columns and the compressed text of every row.

    Rows are dealt by id and length, so that rows without an id do not all meet.
    """
    carry = carry or ["doc_id"]
    kept = [f for f in docs.select(*carry).schema]
    schema = T.StructType(
        [T.StructField("_bucket", T.IntegerType()), *(T.StructField(f.name, f.dataType) for f in kept), T.StructField("_z", T.BinaryType())]
    )

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            packed = [None if t is None else press.compress(t) for t in texts.cast(pa.binary()).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    bucket = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(parts(docs.sparkSession))).cast("int")
    return docs.select(bucket.alias("_bucket"), *carry, F.col("text").alias("_text")).mapInArrow(squeeze, schema)


def opened(table: pa.Table, most: int) -> Iterator[tuple[pa.Table, pa.Array]]:
    """The rows of a bucket with their texts, in pieces of about ``most`` bytes of text."""
    spread = zstandard.ZstdDecompressor()
    begin, texts, held = 0, [], 0
    for n, z in enumerate(table.column("_z").to_pylist()):
        text = b"" if z is None else spread.decompress(z)
        if held and held + len(text) > most:
            yield table.slice(begin, n - begin), pa.array(texts, pa.large_binary())
            begin, texts, held = n, [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield table.slice(begin), pa.array(texts, pa.large_binary())


def ask(buckets: DataFrame, question: Callable[[pa.Table], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """What each bucket asks: ``question`` gives (shard, bucket, block)."""

    def run(table: pa.Table) -> pa.Table:
        return _rows(question(table), "_shard", "_bucket")

    return buckets.groupBy("_bucket").applyInArrow(run, ASKED)


def answer(asked: DataFrame, reply: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """What each shard answers: ``reply`` gets the shard, its buckets and blocks, gives (bucket, block)."""

    def run(table: pa.Table) -> pa.Table:
        shard, buckets = table.column("_shard")[0].as_py(), table.column("_bucket").to_pylist()
        return _rows(reply(shard, buckets, table.column("_blob").to_pylist()), "_bucket")

    return asked.groupBy("_shard").applyInArrow(run, ANSWERED)


def answer_with(
    asked: DataFrame, sent: DataFrame, reply: Callable[[int, list[int], list[bytes], list[bytes]], Iterator[tuple[int, bytes]]]
) -> DataFrame:
    """As ``answer``, with the blocks that a second question sent to the same shard."""

    def run(table: pa.Table, more: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(iter(()), "_bucket")
        shard, buckets = table.column("_shard")[0].as_py(), table.column("_bucket").to_pylist()
        return _rows(reply(shard, buckets, table.column("_blob").to_pylist(), more.column("_blob").to_pylist()), "_bucket")

    return asked.groupBy("_shard").cogroup(sent.groupBy("_shard")).applyInArrow(run, ANSWERED)


def tell(
    buckets: DataFrame, answers: DataFrame, use: Callable[[pa.Table, list[bytes]], Iterator[pa.RecordBatch]], schema: T.StructType | str
) -> DataFrame:
    """Rows made from each bucket and the blocks sent to it."""
    arrow = _arrow_schema(schema)

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        found = pa.Table.from_batches(list(use(table, replies.column("_blob").to_pylist())), arrow)
        blocks.give_back()
        return found

    return buckets.groupBy("_bucket").cogroup(answers.groupBy("_bucket")).applyInArrow(run, schema)


def ask_again(
    buckets: DataFrame, answers: DataFrame, question: Callable[[pa.Table, list[bytes]], Iterator[tuple[int, int, bytes]]]
) -> DataFrame:
    """A second question that depends on the answers to the first."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        found = question(table, replies.column("_blob").to_pylist()) if table.num_rows else iter(())
        return _rows(found, "_shard", "_bucket")

    return buckets.groupBy("_bucket").cogroup(answers.groupBy("_bucket")).applyInArrow(run, ASKED)


def _rows(found: Iterator[tuple], *names: str) -> pa.Table:
    rows = list(found)
    columns = [pa.array([r[i] for r in rows], pa.int32()) for i in range(len(names))]
    blocks.give_back()
    return pa.table([*columns, pa.array([r[-1] for r in rows], pa.binary())], names=[*names, "_blob"])


def _arrow_schema(schema: T.StructType | str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def doc_ids(table: pa.Table, missing: int = (1 << 63) - 1) -> np.ndarray:
    """The ids as numbers; a missing id comes after every other if nothing else is said."""
    return pc.fill_null(table.column("doc_id").cast(pa.int64()), missing).to_numpy()
