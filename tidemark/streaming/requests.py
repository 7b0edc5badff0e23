"""Final outcomes of requests while their attempts are still being written.

An attempt may be the last one that is ever made, and nothing says so.  State is kept
of every request: which attempts were seen and what they decided.  A request is final
when all its attempts were used, or when its patience has run out in event time; a
request that fell silent without an answer is then unavailable, not pending.

Requests are many and small, so Spark deals them into buckets, and what is known of a
bucket's requests is one value of its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.fixed_values import MAX_ATTEMPTS

KEY = ("venue", "url", "params", "run")
OUT = "venue string, url string, params string, run string, attempts bigint, final_outcome string, detail string"
#: Of each request: attempts seen as bits, the highest, the weight and the text that decide the
#: detail, the latest attempt, when patience ends, and whether the request was told.
_NUMBERS = ("seen", "highest", "weight", "latest", "ends", "told")
_REQUESTS = pa.schema([*[(k, pa.string()) for k in (*KEY, "detail")], *[(n, pa.int64()) for n in _NUMBERS]])
_STATE = "requests binary"
_WEIGHT = {"ok": 2, "rejected": 1}
_OUTCOME = {2: "ok", 1: "rejected", 0: "unavailable"}
_HEAVY = 1_000_000


def final_outcomes(
    attempts: DataFrame, lateness: str, patience_seconds: int, max_attempts: int = MAX_ATTEMPTS, buckets: int = 1024
) -> DataFrame:
    """A stream of attempts to a stream with one row per finished request.

    ``attempts`` has the request (venue, url, params, run), requested_at, attempt,
    outcome and detail.  Rows without params are polls of the journal: they only say
    that it was looked at.  An attempt that is seen again changes nothing, and a
    finished request is remembered for another ``patience_seconds``, so that late copies
    are not a new request.  The open requests of one of the ``buckets`` must fit a task;
    their number is part of what a checkpoint holds.
    """
    is_attempt = F.when(F.col("requested_at").isNotNull(), F.col("params")).isNotNull()
    wanted = attempts.select(*[F.coalesce(F.col(k), F.lit("")).alias(k) if k == "run" else F.col(k) for k in KEY],
                             "requested_at", "attempt", "outcome", F.coalesce("detail", F.lit("")).alias("detail"))
    patience = patience_seconds * 1_000

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        known = [_read(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            known += [_attempts(rows, patience) for rows in batches if len(rows)]
        requests = _merged(pd.concat(known, ignore_index=True))
        # Patience with a request that was told before is the time it is remembered for.
        over = requests["ends"] < now
        requests = requests[~(over & (requests["told"] == 1))].copy()
        due = (requests["told"] == 0) & ((requests["seen"] == (2 << max_attempts) - 2) | over)
        if due.any():
            yield _answers(requests[due])
        requests.loc[due, "told"] = 1
        requests.loc[due & over, "ends"] = now + patience
        if not len(requests):
            state.remove()
            return
        state.update((_written(requests),))
        state.setTimeoutTimestamp(max(int(requests["ends"].min()), now + 1))

    return (
        wanted.withWatermark("requested_at", lateness)
        .where(is_attempt)
        .withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(follow, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def _attempts(rows: pd.DataFrame, patience: int) -> pd.DataFrame:
    """Each attempt as a request of its own."""
    attempt = rows["attempt"].to_numpy().astype(np.int64)
    latest = rows["requested_at"].to_numpy().astype("datetime64[ms]").astype(np.int64)
    # As in a finished journal: an answer, else a refusal, else the last failure.
    weight = rows["outcome"].map(_WEIGHT).fillna(0).to_numpy().astype(np.int64) * _HEAVY + attempt
    numbers = (np.left_shift(1, attempt), attempt, weight, latest, latest + patience, np.zeros(len(rows), np.int64))
    return rows[[*KEY, "detail"]].assign(**dict(zip(_NUMBERS, numbers, strict=True)))


def _merged(known: pd.DataFrame) -> pd.DataFrame:
    """One row per request; the detail is that of the greatest weight, the later one of equals."""
    request = known.groupby(list(KEY), sort=False, dropna=False).ngroup().to_numpy()
    order = np.lexsort((known["weight"].to_numpy(), request))
    starts = np.flatnonzero(np.diff(request[order], prepend=-1))
    last = np.append(starts[1:], len(order)) - 1
    merged = known.iloc[order[last]].reset_index(drop=True)
    for name in _NUMBERS:
        join = np.bitwise_or if name == "seen" else np.maximum
        merged[name] = join.reduceat(known[name].to_numpy()[order], starts)
    return merged


def _answers(requests: pd.DataFrame) -> pd.DataFrame:
    outcome = (requests["weight"] // _HEAVY).map(_OUTCOME)
    return requests[[*KEY]].assign(attempts=requests["highest"], final_outcome=outcome, detail=requests["detail"])


def _written(requests: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _REQUESTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(pa.Table.from_pandas(requests, _REQUESTS, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _read(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_pandas()
