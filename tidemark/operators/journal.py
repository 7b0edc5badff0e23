"""The request journal: attempts, endpoints, final outcomes and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import MAX_ATTEMPTS

REQUEST = ("venue", "url", "params")
#: Further columns that tell requests apart, where a journal has them: a request may be
#: made again by a later run.
RUN = ("method", "run")


def endpoint_summary(journal: DataFrame) -> DataFrame:
    """Attempts, successes and bytes per venue and endpoint."""
    return journal.groupBy("venue", "url").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("outcome") == "ok").alias("ok"),
        F.sum("payload_bytes").cast("bigint").alias("bytes"),
    )


def final_outcomes(journal: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per logical request: ok, rejected, unavailable or pending.

    A success or a refusal on any attempt decides and gives the detail; a request
    whose attempts were all used up without either is unavailable.  The same
    request of two runs is two requests: ``run`` names the run, if there is one.
    """
    keys = [*REQUEST, *(name for name in RUN if name in journal.columns)]
    ok = F.col("outcome") == "ok"
    rejected = F.col("outcome") == "rejected"
    return (
        journal.groupBy(*keys)
        .agg(
            F.max("attempt").alias("attempts"),
            F.bool_or(ok).alias("any_ok"),
            F.bool_or(rejected).alias("any_rejected"),
            F.max_by("detail", F.struct(ok, rejected, "attempt")).alias("detail"),
        )
        .select(
            *keys,
            "attempts",
            F.when(F.col("any_ok"), F.lit("ok"))
            .when(F.col("any_rejected"), F.lit("rejected"))
            .when(F.col("attempts") >= max_attempts, F.lit("unavailable"))
            .otherwise(F.lit("pending"))
            .alias("final_outcome"),
            "detail",
        )
    )


def fetch_failures(finals: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Symbols whose fetch failed, with the whole reason."""
    reason = F.concat(F.col("final_outcome"), F.lit(": "), F.col("detail"))
    return finals.where(F.col("final_outcome").isin("rejected", "unavailable")).select(
        "venue", symbol, reason.alias("reason")
    )


def delisted_probe(probe: DataFrame, finals: DataFrame, bar_stats: DataFrame) -> DataFrame:
    """found, empty, rejected or unavailable per named symbol, with bar evidence.

    ``finals`` has (venue, symbol, final_outcome, detail) and ``bar_stats`` has
    (venue, symbol, bars, first_open, last_open).  The probe keeps its own
    columns, such as the source that says the symbol is gone.
    """
    outcome = (
        F.when(F.col("final_outcome").isNull(), F.lit("not_requested"))
        .when(F.col("final_outcome") != "ok", F.col("final_outcome"))
        .when(F.coalesce("bars", F.lit(0)) > 0, F.lit("found"))
        .otherwise(F.lit("empty"))
    )
    answered = F.col("final_outcome") == "ok"
    return (
        probe.join(finals, ["venue", "symbol"], "left")
        .join(bar_stats, ["venue", "symbol"], "left")
        .select(
            *probe.columns,
            outcome.alias("outcome"),
            F.when(~answered, F.col("detail")).alias("detail"),
            F.when(answered, F.coalesce("bars", F.lit(0))).alias("bar_count"),
            F.when(answered, F.col("first_open")).alias("first_bar"),
            F.when(answered, F.col("last_open")).alias("last_bar"),
        )
    )
