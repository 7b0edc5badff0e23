"""SRC: landed payloads, stored tables and prints to typed rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.fixed_values import TIMEFRAME_SECONDS
from tidemark.functions import instants as ts
from tidemark.session import staging_path
from tidemark.sinks.bars import BarStore
from tidemark.sinks.records import calendar_documents, read_calendar_json
from tidemark.sources import bars, books, datasets, metadata
from tidemark.workloads import fixtures as fx
from tidemark.workloads import payloads
from tidemark.workloads.edge import exact, stamp
from tidemark.workloads.registry import query

_ISO = "'%Y-%m-%dT%H:%M:%S'"


def _moment(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


@query(
    "src_1_parse_klines",
    f"""
    SELECT venue, symbol, strftime(open_time, {_ISO}) AS open_time,
           open::DECIMAL(34,2)::VARCHAR AS open, high::DECIMAL(34,2)::VARCHAR AS high,
           low::DECIMAL(34,2)::VARCHAR AS low, close::DECIMAL(34,2)::VARCHAR AS close,
           volume::DECIMAL(34,2)::VARCHAR AS volume,
           CASE WHEN day(open_time) <> 17 THEN quote_volume::DECIMAL(34,2)::VARCHAR END AS quote_volume,
           open_time < max(open_time) OVER (PARTITION BY venue, symbol, date_trunc('month', open_time)) AS is_closed,
           CASE WHEN day(open_time) = 17 THEN 'too few fields' ELSE '' END AS reason
    FROM fx_bars""",
)
def parse_klines(spark, sf_dir):
    return bars.parse_klines(payloads.klines(spark, sf_dir)).select(
        "venue",
        "symbol",
        stamp("open_time"),
        *[exact(name, 2) for name in ("open", "high", "low", "close", "volume", "quote_volume")],
        "is_closed",
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


@query(
    "src_2_kline_window",
    f"""
    SELECT venue, symbol, count(*) AS bars, strftime(min(open_time), {_ISO}) AS first_open,
           strftime(max(open_time), {_ISO}) AS last_open
    FROM (SELECT *, max(open_time) OVER (PARTITION BY venue, symbol, date_trunc('month', open_time)) AS seen
          FROM fx_bars)
    WHERE day(open_time) <> 17 AND open_time < seen
      AND open_time >= TIMESTAMP '1998-02-10' AND open_time < TIMESTAMP '1999-05-20'
    GROUP BY ALL""",
)
def kline_window(spark, sf_dir):
    parsed = bars.good_bars(bars.parse_klines(payloads.klines(spark, sf_dir)))
    ranged = bars.within(parsed, _moment("1998-02-10"), _moment("1999-05-20"))
    return ranged.groupBy("venue", "symbol").agg(
        F.count("*").alias("bars"),
        stamp(F.min("open_time"), "first_open"),
        stamp(F.max("open_time"), "last_open"),
    )


@query(
    "src_3_parse_ohlc",
    f"""
    SELECT venue, symbol, strftime(open_time, {_ISO}) AS open_time, close::DECIMAL(34,2)::VARCHAR AS close,
           (((high + low) * 0.5)::DECIMAL(18,3) * volume::DECIMAL(18,2))::DECIMAL(34,5)::VARCHAR AS quote_volume
    FROM (SELECT *, max(open_time) OVER (PARTITION BY venue, symbol, date_trunc('month', open_time)) AS seen
          FROM fx_bars)
    WHERE open_time < seen AND open_time >= TIMESTAMP '1996-01-15' AND open_time < TIMESTAMP '2001-01-15'""",
)
def parse_ohlc(spark, sf_dir):
    parsed = bars.good_bars(bars.parse_ohlc(payloads.ohlc(spark, sf_dir)))
    ranged = bars.within(parsed, _moment("1996-01-15"), _moment("2001-01-15"))
    return ranged.select(
        "venue", "symbol", stamp("open_time"), exact("close", 2), exact("quote_volume", 5)
    )


@query(
    "src_4_parse_symbol_metadata",
    """
    SELECT venue, symbol, base, quote, CASE WHEN key % 7 = 0 THEN 'BREAK' ELSE status END AS status,
           CASE WHEN size % 5 = 3 THEN '0.05' ELSE '0.01' END AS tick_size,
           CASE WHEN size % 5 <> 4 THEN '0.001' END AS lot_size,
           CASE size % 5 WHEN 1 THEN '7.00' WHEN 2 THEN '0.00' ELSE '10.00' END AS min_notional,
           CASE WHEN size % 5 = 4 THEN 'missing LOT_SIZE.stepSize' ELSE '' END AS reason
    FROM fx_listing""",
)
def parse_symbol_metadata(spark, sf_dir):
    return metadata.parse_symbols(payloads.symbol_descriptions(spark, sf_dir)).select(
        "venue",
        "symbol",
        "base",
        "quote",
        "status",
        exact("tick_size", 2),
        exact("lot_size", 3),
        exact("min_notional", 2),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


@query(
    "src_5_parse_pair_metadata",
    """
    SELECT venue, symbol, canonical, base, quote, 'online' AS status, '0.1' AS tick_size,
           CASE size % 9 WHEN 0 THEN '1.00000000' WHEN 1 THEN '0.10000000' WHEN 2 THEN '0.01000000'
             WHEN 3 THEN '0.00100000' WHEN 4 THEN '0.00010000' WHEN 5 THEN '0.00001000'
             WHEN 6 THEN '0.00000100' WHEN 7 THEN '0.00000010' ELSE '0.00000001' END AS lot_size,
           price::DECIMAL(34,2)::VARCHAR AS min_notional
    FROM fx_listing WHERE size % 6 > 1""",
)
def parse_pair_metadata(spark, sf_dir):
    good = metadata.good_metadata(metadata.parse_pairs(payloads.pair_descriptions(spark, sf_dir)))
    return good.select(
        "venue",
        "symbol",
        "canonical",
        "base",
        "quote",
        "status",
        exact("tick_size", 1),
        # Small decimals print in scientific notation unless formatted.
        F.format_string("%.8f", F.col("lot_size").cast("double")).alias("lot_size"),
        exact("min_notional", 2),
    )


@query(
    "src_5_fine_lots",
    """
    SELECT venue, symbol, decimals, CASE WHEN decimals <= 22 THEN CASE WHEN decimals <= 0 THEN '1' || repeat('0', CAST(-decimals AS INT)) || '.'
               ELSE '0.' || repeat('0', CAST(decimals AS INT) - 1) || '1' END END AS lot_text,
           CASE WHEN decimals > 22 THEN 'lot_decimals: outside what a lot can hold' ELSE '' END AS reason
    FROM (SELECT venue, symbol, key % 36 - 4 AS decimals FROM fx_listing WHERE size % 6 > 1)""",
)
def fine_lots(spark, sf_dir):
    """Lots from 10,000 down to what no decimal can hold; only those are set aside."""
    pages = payloads.pair_descriptions(spark, sf_dir, F.col("key") % 36 - 4)
    parsed = metadata.parse_pairs(pages)
    text = F.col("lot_size").cast("string")
    # Digits and nothing else, without the zeros behind the last one.
    plain = F.regexp_replace(text, "0+$", "")
    return parsed.select(
        "venue",
        "symbol",
        (F.substring("symbol", 2, 20).cast("bigint") % 36 - 4).alias("decimals"),
        plain.alias("lot_text"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )


@query(
    "src_6_metadata_with_halted",
    """
    SELECT venue, count(*) AS symbols,
           count(*) FILTER (status = 'TRADING' AND key % 7 <> 0) AS trading,
           count(*) FILTER (status <> 'TRADING' OR key % 7 = 0) AS halted
    FROM fx_listing WHERE size % 5 <> 4 GROUP BY ALL""",
)
def metadata_with_halted(spark, sf_dir):
    good = metadata.good_metadata(
        metadata.parse_symbols(payloads.symbol_descriptions(spark, sf_dir))
    )
    return metadata.trading_summary(good, fx.profiles(spark))


@query(
    "src_7_archive_symbols",
    """
    SELECT venue, symbol FROM fx_listing WHERE key % 11 <> 3
    UNION SELECT venue, 'Q' || key FROM fx_listing WHERE key % 13 = 0""",
)
def archive_symbols(spark, sf_dir):
    return metadata.archive_symbols(payloads.archive_pages(spark, sf_dir))


@query(
    "src_7_archive_gaps",
    """
    SELECT venue, after, marker, reason FROM (
      SELECT p.venue, 'page not landed' AS reason, CASE WHEN p.nth = 1 THEN '' ELSE 'm' || p.page END AS after, 'm' || n.page AS marker
      FROM fx_archive_page p JOIN fx_archive_page n ON n.venue = p.venue AND n.nth = p.nth + 1
      WHERE p.landed AND p.nth <> 2 AND p.nth % 11 <> 5 AND (NOT n.landed OR n.nth = 2)
      UNION ALL
      SELECT venue, 'truncated without a next marker', CASE WHEN nth = 1 THEN '' ELSE 'm' || page END, NULL FROM fx_archive_page
      WHERE landed AND nth % 11 = 5 AND nth < pages
      UNION ALL SELECT venue, 'first page not landed', NULL, '' FROM fx_archive_page WHERE nth = 1 AND NOT landed
      UNION ALL SELECT venue, 'not a listing page', NULL, NULL FROM fx_archive_page WHERE nth = 2 AND landed)""",
)
def archive_gaps(spark, sf_dir):
    """Which pages of two venues' archive listings are missing, and which page named them."""
    return metadata.archive_gaps(payloads.archive_chain(spark, sf_dir))


_QUOTED = """
    SELECT *, CASE WHEN key % 50 = 0 THEN 0 ELSE (price * 100)::BIGINT END AS bid,
           (price * 100)::BIGINT + (size - 5) * 5 AS ask FROM fx_listing"""
_BPS = "((2 * 200000000::HUGEINT * (ask - bid) + (ask + bid)) // (2 * (ask + bid)))"
_BPS_TEXT = f"({_BPS}::DECIMAL(20,0) / 10000)::DECIMAL(20,4)::VARCHAR"


@query(
    "src_8_ticker_spreads",
    f"""
    SELECT venue, symbol, {_BPS_TEXT} AS spread_bps FROM ({_QUOTED})
    WHERE bid > 0 AND ask > 0 AND ask >= bid AND CAST(substr(base, 7) AS INT) % 2 = 0""",
)
def ticker_spreads(spark, sf_dir):
    """Only symbols of even brands are wanted."""
    wanted = fx.listings(spark, sf_dir).where(F.substring("base", 7, 10).try_cast("int") % 2 == 0)
    spreads = books.ticker_spreads(payloads.tickers(spark, sf_dir), wanted)
    return spreads.select("venue", "symbol", exact("spread_bps", 4))


@query(
    "src_9_level_spreads",
    f"""
    SELECT venue, CASE WHEN size % 6 > 1 THEN symbol ELSE canonical END AS symbol, {_BPS_TEXT} AS spread_bps
    FROM ({_QUOTED}) WHERE bid > 0 AND ask > 0 AND ask >= bid""",
)
def level_spreads(spark, sf_dir):
    """Pairs without a usable display name keep their canonical one."""
    known = metadata.good_metadata(metadata.parse_pairs(payloads.pair_descriptions(spark, sf_dir)))
    spreads = books.level_spreads(payloads.levels(spark, sf_dir), known)
    return spreads.select("venue", "symbol", exact("spread_bps", 4))


def landed_venue(spark, sf_dir: str, venue: str, bars, described_in: str = "symbol_metadata.json") -> str:
    """Write one venue's folder the way a collector leaves it."""
    root = staging_path(spark, f"landed-{venue}")
    described = fx.metadata(spark, sf_dir).where(F.col("venue") == venue)
    entry = F.struct(
        "base",
        "quote",
        "status",
        *[F.col(name).cast("string").alias(name) for name in ("tick_size", "lot_size", "min_notional")],
    )
    one_document(described.groupBy().agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("symbol", entry)))).alias("value")
    ), f"{root}/{described_in}")
    row = F.array(
        F.unix_millis("open_time").cast("string"),
        F.col("close").cast("decimal(18,2)").cast("string"),
        # A turnover that is a round number of hundreds stands for an unknown one.
        F.when(F.col("quote_volume") % 100 == 0, F.lit("")).otherwise(
            F.col("quote_volume").cast("decimal(28,2)").cast("string")
        ),
    )
    (
        bars.where(F.col("venue") == venue)
        .groupBy("symbol", "timeframe", F.year("open_time").alias("year"))
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
        .select("symbol", "timeframe", "rows")
        .write.json(f"{root}/bars")
    )
    snapshot = fx.spreads(spark, sf_dir).where(F.col("venue") == venue)
    pairs = F.map_from_entries(
        F.collect_list(F.struct("symbol", F.col("spread_bps").cast("decimal(10,2)").cast("string")))
    )
    one_document(snapshot.groupBy().agg(
        F.to_json(
            F.struct(F.lit("2001-11-05T12:00:00+00:00").alias("observed_at"), pairs.alias("bps"))
        ).alias("value")
    ), f"{root}/spread_snapshot.json")
    return root


def one_document(frame, path: str) -> None:
    frame.coalesce(1).write.text(path)


@query(
    "src_10_venue_dataset",
    """
    SELECT m.venue, m.symbol, m.quote, m.status, b.bars, b.turnovers, b.last_close,
           m.spread_bps::DECIMAL(10,2)::VARCHAR AS spread_bps
    FROM fx_meta m JOIN (
      SELECT venue, symbol, count(*) AS bars, count(*) FILTER (quote_volume % 100 <> 0) AS turnovers,
             arg_max(close, open_time)::DECIMAL(34,2)::VARCHAR AS last_close
      FROM fx_bars GROUP BY ALL) b USING (venue, symbol)""",
)
def venue_dataset(spark, sf_dir):
    """Both venues' folders; the second describes its symbols under the other file name."""
    bars = fx.staged_bars(spark, sf_dir)
    found = [
        datasets.load(spark, venue, landed_venue(spark, sf_dir, venue, bars, described), series_per_line=True)
        for venue, described in zip(("alpha", "beta"), datasets.METADATA_FILES, strict=True)
    ]
    files = datasets.together(found)
    stats = files.bars.groupBy("venue", "symbol").agg(
        F.count("*").alias("bars"),
        F.count("quote_volume").alias("turnovers"),
        exact(F.max_by("close", "open_time"), 2, "last_close"),
    )
    return (
        files.metadata.select("venue", "symbol", "quote", "status")
        .join(stats, ["venue", "symbol"])
        .join(files.spreads.select("venue", "symbol", exact("spread_bps", 2)), ["venue", "symbol"], "left")
    )


def stored(spark, sf_dir: str) -> BarStore:
    store = BarStore(spark, staging_path(spark, "store"))
    store.write(
        fx.daily_bars(spark, sf_dir).withColumn(
            "is_closed", ts.close_time(F.col("open_time"), F.col("timeframe")) <= _moment("2001-06-15 12:00:00")
        )
    )
    return store


@query(
    "src_11_read_stored_bars",
    f"""
    SELECT venue, symbol, strftime(open_time, {_ISO}) AS open_time, close::DECIMAL(34,2)::VARCHAR AS close,
           quote_volume::DECIMAL(34,2)::VARCHAR AS quote_volume
    FROM fx_bars JOIN fx_meta USING (venue, symbol)
    WHERE quote = 'EUR' AND open_time >= TIMESTAMP '2000-11-20' AND open_time < TIMESTAMP '2001-07-04'
      AND open_time + INTERVAL 1 DAY <= TIMESTAMP '2001-06-15 12:00:00'""",
)
def read_stored_bars(spark, sf_dir):
    wanted = fx.metadata(spark, sf_dir).where("quote = 'EUR'")
    found = stored(spark, sf_dir).read(wanted, _moment("2000-11-20"), _moment("2001-07-04"))
    return found.select(
        "venue", "symbol", stamp("open_time"), exact("close", 2), exact("quote_volume", 2)
    )


@query(
    "src_12_latest_close_time",
    f"""
    SELECT i.venue, i.symbol, strftime(max(b.open_time) + INTERVAL 1 DAY, {_ISO}) AS latest_close
    FROM (SELECT venue, symbol FROM fx_calendar) i LEFT JOIN fx_bars b ON b.venue = i.venue
     AND b.symbol = i.symbol AND b.open_time + INTERVAL 1 DAY <= TIMESTAMP '2001-06-15 12:00:00'
    GROUP BY ALL""",
)
def latest_close_time(spark, sf_dir):
    """Announced but unseen instruments have no bars, so their answer is NULL."""
    market = fx.market(spark, sf_dir, with_bars=True)
    asked = market.calendar.select("venue", "symbol", F.lit("1d").alias("timeframe"))
    flagged = market.bars.withColumn(
        "is_closed",
        ts.close_time(F.col("open_time"), F.col("timeframe")) <= _moment("2001-06-15 12:00:00"),
    )
    return bars.latest_close_time(asked, flagged).select("venue", "symbol", stamp("latest_close"))


@query(
    "src_13_multi_instrument_read",
    f"""
    SELECT venue, symbol, count(*) AS bars, strftime(min(open_time), {_ISO}) AS first_open
    FROM (SELECT *, max(open_time) OVER (PARTITION BY venue, symbol, date_trunc('month', open_time)) AS seen
          FROM fx_bars) JOIN fx_meta USING (venue, symbol)
    WHERE status = 'TRADING' AND open_time < seen AND (venue = 'beta' OR day(open_time) <> 17)
      AND open_time >= TIMESTAMP '1997-01-01' AND open_time < TIMESTAMP '1998-01-01'
    GROUP BY ALL""",
)
def multi_instrument_read(spark, sf_dir):
    """Both payload formats in one read; an unknown instrument adds nothing."""
    arrays = payloads.klines(spark, sf_dir).where("venue = 'alpha'")
    envelopes = payloads.ohlc(spark, sf_dir).where("venue = 'beta'")
    everything = bars.good_bars(bars.parse_klines(arrays)).unionByName(
        bars.good_bars(bars.parse_ohlc(envelopes))
    )
    wanted = fx.metadata(spark, sf_dir).where("status = 'TRADING'").select("venue", "symbol")
    unknown = wanted.select("venue", F.lit("Nothing#0").alias("symbol")).distinct()
    ranged = bars.within(
        bars.for_instruments(everything, wanted.unionByName(unknown)),
        _moment("1997-01-01"),
        _moment("1998-01-01"),
    )
    return ranged.groupBy("venue", "symbol").agg(
        F.count("*").alias("bars"), stamp(F.min("open_time"), "first_open")
    )


@query(
    "src_14_calendar_json",
    f"""
    SELECT venue, symbol, strftime(listed_at, {_ISO}) AS listed_at, strftime(delisted_at, {_ISO}) AS delisted_at,
           provenance, note, metadata_available FROM fx_calendar""",
)
def calendar_json(spark, sf_dir):
    """Calendar documents written and read back."""
    path = staging_path(spark, "calendar-json")
    calendar_documents(fx.market(spark, sf_dir).calendar).write.json(path)
    return read_calendar_json(spark, path, one_per_file=False).select(
        "venue",
        "symbol",
        stamp("listed_at"),
        stamp("delisted_at"),
        "provenance",
        "note",
        "metadata_available",
    )


@query(
    "src_15_earliest_bar",
    f"""
    SELECT venue, symbol, strftime(first_open, {_ISO}) AS earliest_open FROM fx_extent""",
)
def earliest_bar(spark, sf_dir):
    return bars.earliest_open_time(fx.daily_bars(spark, sf_dir)).select(
        "venue", "symbol", stamp("earliest_open")
    )


def intraday_bars(spark, sf_dir):
    """One-minute bars from prints, the five longer timeframes from those."""
    fine = bars.from_prints(fx.intraday_prints(spark, sf_dir), "1m", ["ts", "event_id"])
    # The one-minute bars are one of the roll-up's outputs, so prints are read once.
    return bars.roll_up(fine, list(TIMEFRAME_SECONDS))


@query(
    "src_16_bars_from_prints",
    f"""
    SELECT venue, symbol, timeframe, strftime(open_time, {_ISO}) AS open_time,
           open::DECIMAL(34,2)::VARCHAR AS open, high::DECIMAL(34,2)::VARCHAR AS high,
           low::DECIMAL(34,2)::VARCHAR AS low, close::DECIMAL(34,2)::VARCHAR AS close,
           volume::DECIMAL(34,2)::VARCHAR AS volume, quote_volume::DECIMAL(34,2)::VARCHAR AS quote_volume
    FROM fx_intraday_bars""",
)
def bars_from_prints(spark, sf_dir):
    return intraday_bars(spark, sf_dir).select(
        "venue",
        "symbol",
        "timeframe",
        stamp("open_time"),
        *[exact(name, 2) for name in ("open", "high", "low", "close", "volume", "quote_volume")],
    )
