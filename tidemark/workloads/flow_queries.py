"""SNK-1..4 and STR: tables written and read back, and streams run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import history, listing
from tidemark.session import staging_path
from tidemark.sinks import bars as bar_sink
from tidemark.sinks import bucketed, records
from tidemark.streaming import corrected_bars, ingest, live_bars, requests
from tidemark.workloads import fixtures as fx
from tidemark.workloads.edge import exact, stamp
from tidemark.workloads.registry import query

_ISO = "'%Y-%m-%dT%H:%M:%S'"
#: Where the landed prints of the month are cut.
_LANDINGS = ("2024-01-12", "2024-01-22")
_LATENESS = 600
_BARS = f"""
    SELECT venue, symbol, strftime(open_time, {_ISO}) AS open_time, close::DECIMAL(34,2)::VARCHAR AS close,
           quote_volume::DECIMAL(34,2)::VARCHAR AS quote_volume FROM fx_bars"""


def _bar_rows(frame):
    return frame.select(
        "venue", "symbol", stamp("open_time"), exact("close", 2), exact("quote_volume", 2)
    )


def _early_copy(bars):
    """Every bar as first seen: an hour early and with a wrong close."""
    return bars.withColumn("close", F.lit(1).cast("decimal(20,10)")).withColumn(
        "observed_at", F.col("observed_at") - F.expr("INTERVAL 1 HOUR")
    )


@query("snk_1_idempotent_write", _BARS)
def idempotent_write(spark, sf_dir):
    """Final copies twice, then early ones on top: the final ones stay."""
    store = bar_sink.BarStore(spark, staging_path(spark, "store"))
    final = fx.staged_bars(spark, sf_dir)
    for batch in (final, final, _early_copy(final)):
        store.write(batch)
    return _bar_rows(store.table())


@query(
    "snk_1_bucketed_store",
    f"""
    SELECT venue, symbol, strftime(open_time, {_ISO}) AS open_time, close::DECIMAL(34,2)::VARCHAR AS close,
           row_number() OVER (PARTITION BY venue, symbol ORDER BY open_time) AS ordinal,
           strftime(min(open_time) OVER (PARTITION BY venue, symbol), {_ISO}) AS first_open
    FROM fx_bars""",
)
def bucketed_store(spark, sf_dir):
    """Final copies twice, then early ones; histories and extents are read without a shuffle of bars."""
    path = staging_path(spark, "bucketed")
    store = bucketed.BucketedBars(spark, f"bars_{path[-32:]}", path, 8)
    store.create()
    final = fx.staged_bars(spark, sf_dir)
    for batch in (final, final, _early_copy(final)):
        store.write(batch)
    return history.ordinals_in_place(store.table()).select(
        "venue", "symbol", stamp("open_time"), exact("close", 2), "ordinal", stamp("first_open")
    )


@query(
    "snk_2_series_dataset",
    """
    SELECT venue, symbol, '1d' AS timeframe, count(*) AS rows, max(epoch_ms(open_time)) AS last_millis,
           arg_max(close, open_time)::DECIMAL(34,2)::VARCHAR AS last_close FROM fx_bars GROUP BY ALL""",
)
def series_dataset(spark, sf_dir):
    path = staging_path(spark, "series")
    bar_sink.write_series(fx.daily_bars(spark, sf_dir), path)
    return bar_sink.read_series(spark, path).groupBy("venue", "symbol", "timeframe").agg(
        F.count("*").alias("rows"),
        F.max("open_millis").alias("last_millis"),
        exact(F.max_by("close", "open_millis"), 2, "last_close"),
    )


@query(
    "snk_3_calendar_table",
    f"""
    SELECT venue, symbol, strftime(delisted_at, {_ISO}) AS delisted_at, provenance,
           '{listing.METHOD}' AS methodology FROM fx_calendar""",
)
def calendar_table(spark, sf_dir):
    path = staging_path(spark, "calendar")
    records.write_calendar(fx.market(spark, sf_dir).calendar, path)
    return spark.read.parquet(path).select(
        "venue", "symbol", stamp("delisted_at"), "provenance", "methodology"
    )


@query(
    "snk_4_journal_lines",
    """
    SELECT symbol, outcome, count(*) AS attempts, sum(payload_bytes)::BIGINT AS bytes
    FROM fx_journal GROUP BY ALL""",
)
def journal_lines(spark, sf_dir):
    path = staging_path(spark, "journal")
    records.write_journal(fx.journal(spark, sf_dir), path)
    lines = records.read_journal(spark, path)
    return lines.groupBy(F.col("params")["symbol"].alias("symbol"), "outcome").agg(
        F.count("*").alias("attempts"), F.sum("payload_bytes").alias("bytes")
    )


@query(
    "agg_8_outcomes_of_stream",
    """
    SELECT venue, url, params, max(attempt)::BIGINT AS attempts,
           CASE WHEN bool_or(outcome = 'ok') THEN 'ok' WHEN bool_or(outcome = 'rejected') THEN 'rejected' ELSE 'unavailable' END AS final_outcome,
           arg_max(detail, (outcome = 'ok')::INT * 200 + (outcome = 'rejected')::INT * 100 + attempt) AS detail
    FROM fx_journal WHERE request % 10 <> 3 OR attempt <= 2 GROUP BY ALL""",
)
def outcomes_of_stream(spark, sf_dir):
    """The journal as it is written, in three landings; every tenth request falls silent after two attempts.

    A last poll, a day after the last attempt, ends the patience with the silent ones.
    """
    root = staging_path(spark, "attempts")
    request = F.regexp_extract("params", "start=([0-9]+)", 1).cast("bigint")
    attempts = fx.journal(spark, sf_dir).withColumn("run", F.lit("only")).where((request % 10 != 3) | (F.col("attempt") <= 2))
    newest = attempts.agg(F.max(F.unix_micros("requested_at")).alias("at")).first()["at"]
    first, second = (F.to_timestamp(F.lit(day)) for day in _LANDINGS)
    at = F.col("requested_at")
    day = 86_400_000_000
    parts = (
        (attempts.where(at < first), first),
        (attempts.where((at >= first) & (at < second)), second),
        (attempts.where(at >= second), F.timestamp_micros(F.lit(newest + 40 * day))),
    )
    for landed, observed_at in parts:
        live_bars.land(landed, observed_at, f"{root}/landing", "requested_at")
        stream = live_bars.landed_prints(spark, attempts.schema, f"{root}/landing")
        # Attempts of one request lie up to a month apart in these tables.
        finals = requests.final_outcomes(stream, "0 seconds", 35 * 86_400)
        live_bars.append_available(finals, f"{root}/finals", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/finals").select("venue", "url", "params", "attempts", "final_outcome", "detail")


@query("str_1_incremental_ingest", _BARS)
def incremental_ingest(spark, sf_dir):
    """Landed files taken in twice from one checkpoint; the second run finds the rest.

    The second landing repeats every bar of the first as an early copy, which
    must not replace it.
    """
    root = staging_path(spark, "ingest")
    final = fx.staged_bars(spark, sf_dir)
    store = bar_sink.BarStore(spark, f"{root}/store")
    early_years = F.col("open_time") < F.to_timestamp(F.lit("1999-01-01"))

    def land(rows):
        rows.write.mode("append").parquet(f"{root}/landing")
        stream = ingest.landed_bars(spark, final.schema, f"{root}/landing")
        ingest.ingest_available(stream, store, f"{root}/checkpoint")

    land(final.where(early_years))
    land(final.where(~early_years).unionByName(_early_copy(final.where(early_years))))
    return _bar_rows(store.table())


@query(
    "str_2_closed_bars_stream",
    f"""
    SELECT symbol, strftime(open_time, {_ISO}) AS open_time, open::DECIMAL(34,2)::VARCHAR AS open,
           high::DECIMAL(34,2)::VARCHAR AS high, low::DECIMAL(34,2)::VARCHAR AS low,
           close::DECIMAL(34,2)::VARCHAR AS close, volume::DECIMAL(34,2)::VARCHAR AS volume
    FROM fx_intraday_bars
    WHERE timeframe = '1h' AND open_time + INTERVAL 1 HOUR
      <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
)
def closed_bars_stream(spark, sf_dir):
    """Hourly bars from the stream of prints; the last, still open hours are held back."""
    root = staging_path(spark, "live")
    schema = fx.table(spark, sf_dir, "events").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    closed = live_bars.closed_bars(fx.as_prints(stream), "1h", "10 minutes", ["ts", "event_id"])
    live_bars.append_available(closed, f"{root}/bars", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/bars").select(
        "symbol",
        stamp("open_time"),
        *[exact(name, 2) for name in ("open", "high", "low", "close", "volume")],
    )


def _intraday_rows(bars, *more):
    return bars.select(
        "symbol",
        stamp("open_time"),
        *[exact(name, 2) for name in ("open", "high", "low", "close", "volume")],
        *more,
    )


def _last_look(spark, sf_dir):
    """Somebody looks once the hour of the last print and the lateness are over."""
    newest = fx.intraday_prints(spark, sf_dir).agg(F.max(F.unix_micros("ts")).alias("at")).first()["at"]
    hour = 3_600_000_000
    return F.timestamp_micros(F.lit((newest // hour + 1) * hour + _LATENESS * 1_000_000))


_HOURS = f"""
    SELECT symbol, strftime(open_time, {_ISO}) AS open_time, open::DECIMAL(34,2)::VARCHAR AS open,
           high::DECIMAL(34,2)::VARCHAR AS high, low::DECIMAL(34,2)::VARCHAR AS low,
           close::DECIMAL(34,2)::VARCHAR AS close, volume::DECIMAL(34,2)::VARCHAR AS volume"""


@query("str_2_closed_by_observation", f"{_HOURS} FROM fx_intraday_bars WHERE timeframe = '1h'")
def closed_by_observation(spark, sf_dir):
    """Hourly bars of a market that falls silent: the last poll closes the last hour.

    The prints land in three parts, each with its poll, and the stream is run after
    each landing; no print follows the last one.
    """
    root = staging_path(spark, "observed")
    prints = fx.intraday_prints(spark, sf_dir)
    first, second = (F.to_timestamp(F.lit(day)) for day in _LANDINGS)
    parts = (
        (prints.where(F.col("ts") < first), first),
        (prints.where((F.col("ts") >= first) & (F.col("ts") < second)), second),
        (prints.where(F.col("ts") >= second), _last_look(spark, sf_dir)),
    )
    for landed, observed_at in parts:
        live_bars.land(landed, observed_at, f"{root}/landing")
        stream = live_bars.landed_prints(spark, prints.schema, f"{root}/landing")
        closed = live_bars.closed_bars(stream, "1h", f"{_LATENESS} seconds", ["ts", "event_id"])
        live_bars.append_available(closed, f"{root}/bars", f"{root}/checkpoint")
    return _intraday_rows(spark.read.parquet(f"{root}/bars"))


@query(
    "str_2_late_corrections",
    f"""
    {_HOURS}, coalesce(late_prints, 0) AS late_prints
    FROM fx_intraday_bars LEFT JOIN (
      SELECT symbol, date_trunc('hour', ts)::TIMESTAMP AS open_time, count(*) AS late_prints
      FROM fx_intraday WHERE event_id % 20 = 0 AND ts < TIMESTAMP '{_LANDINGS[0]}' GROUP BY ALL) USING (symbol, open_time)
    WHERE timeframe = '1h'""",
)
def late_corrections(spark, sf_dir):
    """Hourly bars although every twentieth early print lands ten days late.

    The stream and its corrections give the bars of all prints; beside each stands
    how many of its prints came behind the watermark.
    """
    root = staging_path(spark, "corrected")
    prints = fx.intraday_prints(spark, sf_dir)
    first, second = (F.to_timestamp(F.lit(day)) for day in _LANDINGS)
    late = (F.col("event_id") % 20 == 0) & (F.col("ts") < first)
    keeper = corrected_bars.CorrectedBars(
        bar_sink.BarStore(spark, f"{root}/store"), f"{root}/live", "1h", _LATENESS, ("ts", "event_id")
    )
    parts = (
        (prints.where((F.col("ts") < first) & ~late), first),
        (prints.where((F.col("ts") >= first) & (F.col("ts") < second)), second),
        (prints.where((F.col("ts") >= second) | late), _last_look(spark, sf_dir)),
    )
    for landed, observed_at in parts:
        live_bars.land(landed, observed_at, f"{root}/landing")
        keeper.run_available(live_bars.landed_prints(spark, prints.schema, f"{root}/landing"))
    counts = keeper.late_prints().groupBy("symbol", "open_time").agg(F.count("*").alias("late_prints"))
    bars = keeper.store.table().join(counts, ["symbol", "open_time"], "left")
    return _intraday_rows(bars, F.coalesce("late_prints", F.lit(0)).alias("late_prints"))
