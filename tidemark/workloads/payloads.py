"""Raw venue payloads that Spark renders from the driver tables.

They have the shapes the readers expect, with faults mixed in, so that reading
them is the inverse of a known table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed_values import ARCHIVE_PREFIX
from tidemark.workloads import fixtures as fx


def _text(name: str, scale: int = 2) -> Column:
    return F.col(name).cast(f"decimal(34,{scale})").cast("string")


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def _joined(order: str, text: str) -> Column:
    """Rows of one page in order, comma separated.  A page is a bounded slice."""
    ordered = F.sort_array(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(ordered, lambda row: row[text]), ",")


def _page_of_month(bars: DataFrame, row: Column) -> DataFrame:
    return (
        bars.withColumn("row", row)
        .groupBy("venue", "symbol", "timeframe", F.date_trunc("month", "open_time").alias("page"))
        .agg(_joined("open_time", "row").alias("rows"), F.max("open_time").alias("observed_at"))
    )


def klines(spark, sf_dir: str) -> DataFrame:
    """Array pages, one per symbol and month; rows of the 17th lack their turnover.

    A page is observed when its last bar opens, so that bar is still forming.
    """
    whole = F.concat(
        F.lit("["),
        F.concat_ws(
            ",",
            F.unix_millis("open_time").cast("string"),
            *[_quoted(_text(name)) for name in ("open", "high", "low", "close", "volume")],
            F.unix_millis("open_time").cast("string"),
        ),
    )
    rest = F.concat(F.lit(","), _quoted(_text("quote_volume")), F.lit(',0,"0","0","0"]'))
    row = F.concat(whole, F.when(F.dayofmonth("open_time") == 17, F.lit("]")).otherwise(rest))
    return _page_of_month(fx.daily_bars(spark, sf_dir), row).select(
        "venue",
        "symbol",
        "timeframe",
        "observed_at",
        F.concat(F.lit("["), F.col("rows"), F.lit("]")).alias("payload"),
    )


def ohlc(spark, sf_dir: str) -> DataFrame:
    """Envelope pages in epoch seconds; the weighted price is mid of high and low."""
    bars = fx.daily_bars(spark, sf_dir).withColumn(
        "vwap", (F.col("high") + F.col("low")) * F.lit("0.5").cast("decimal(1,1)")
    )
    row = F.concat(
        F.lit("["),
        F.concat_ws(
            ",",
            F.unix_seconds("open_time").cast("string"),
            *[_quoted(_text(name)) for name in ("open", "high", "low", "close")],
            _quoted(_text("vwap", 3)),
            _quoted(_text("volume")),
            F.lit("7"),
        ),
        F.lit("]"),
    )
    return _page_of_month(bars, row).select(
        "venue",
        "symbol",
        "timeframe",
        "observed_at",
        F.concat(
            F.lit('{"error":[],"result":{"last":1,'),
            _quoted(F.col("symbol")),
            F.lit(":["),
            F.col("rows"),
            F.lit("]}}"),
        ).alias("payload"),
    )


def _pages(rows: DataFrame, size: int, first_page: int = 0) -> DataFrame:
    """(venue, page, rows): a fixed number of keys per page."""
    return (
        rows.withColumn("page", F.floor(F.col("key") / size) + first_page)
        .groupBy("venue", "page")
        .agg(_joined("key", "row").alias("rows"))
    )


def symbol_descriptions(spark, sf_dir: str) -> DataFrame:
    """Symbol pages.  Every seventh symbol is described again later, as halted."""
    kind = F.col("size") % 5
    price_filter = '{"filterType":"PRICE_FILTER","tickSize":"%s"}'
    lot_filter = ',{"filterType":"LOT_SIZE","stepSize":"0.001"}'
    newer = ',{"filterType":"NOTIONAL","minNotional":"10"}'
    older = ',{"filterType":"MIN_NOTIONAL","minNotional":"7"}'
    filters = (
        F.when(kind == 0, F.lit(price_filter % "0.01" + lot_filter + newer + older))
        .when(kind == 1, F.lit(price_filter % "0.01" + older + lot_filter))
        .when(kind == 2, F.lit(lot_filter[1:] + "," + price_filter % "0.01"))
        .when(
            kind == 3,
            F.lit(price_filter % "9.99" + "," + price_filter % "0.05" + lot_filter + newer),
        )
        .otherwise(F.lit(price_filter % "0.01" + newer))
    )
    described = fx.listings(spark, sf_dir)

    def page(rows: DataFrame, first_page: int) -> DataFrame:
        row = F.concat(
            F.lit('{"symbol":"'), F.col("symbol"),
            F.lit('","baseAsset":"'), F.col("base"),
            F.lit('","quoteAsset":"'), F.col("quote"),
            F.lit('","status":"'), F.col("status"),
            F.lit('","filters":['), filters, F.lit("]}"),
        )
        return _pages(rows.withColumn("row", row), 200, first_page)

    again = described.where(F.col("key") % 7 == 0).withColumn("status", F.lit("BREAK"))
    pages = page(described, 0).unionByName(page(again, 1_000_000_000))
    return pages.select(
        "venue",
        "page",
        F.concat(F.lit('{"symbols":['), F.col("rows"), F.lit("]}")).alias("payload"),
    )


def pair_descriptions(spark, sf_dir: str, lot_decimals: Column | None = None) -> DataFrame:
    """Pair pages keyed by canonical name; some have no usable display name."""
    decimals = F.col("size") % 9 if lot_decimals is None else lot_decimals
    kind = F.col("size") % 6
    name = (
        F.when(kind == 0, F.lit(""))
        .when(kind == 1, F.lit('"wsname":"A/B/C",'))
        .otherwise(F.concat(F.lit('"wsname":"'), F.col("base"), F.lit("/"), F.col("quote"), F.lit('",')))
    )
    row = F.concat(
        _quoted(F.col("canonical")),
        F.lit(':{"altname":"'), F.col("symbol"), F.lit('",'), name,
        F.lit('"status":"online","tick_size":"0.1","lot_decimals":'),
        decimals.cast("string"),
        F.lit(',"costmin":"'), F.col("price").cast("string"), F.lit('"}'),
    )
    return _pages(fx.listings(spark, sf_dir).withColumn("row", row), 200).select(
        "venue",
        "page",
        F.concat(F.lit('{"error":[],"result":{'), F.col("rows"), F.lit("}}")).alias("payload"),
    )


def archive_pages(spark, sf_dir: str) -> DataFrame:
    """Bucket listing pages: they lack some symbols and know some others."""
    listed = fx.listings(spark, sf_dir)
    entry = lambda prefix, name: F.concat(
        F.lit(f"<CommonPrefixes><Prefix>{prefix}"), name, F.lit("/</Prefix></CommonPrefixes>")
    )
    gone = F.concat(F.lit("Q"), F.col("key").cast("string"))
    row = F.concat(
        F.when(F.col("key") % 11 != 3, entry(ARCHIVE_PREFIX, F.col("symbol"))).otherwise(""),
        F.when(F.col("key") % 13 == 0, entry(ARCHIVE_PREFIX, gone)).otherwise(""),
        F.when(F.col("key") % 17 == 0, entry("data/futures/um/", F.col("symbol"))).otherwise(""),
    )
    return _pages(listed.withColumn("row", row), 500).select(
        "venue",
        F.concat(
            F.lit(f"<ListBucketResult><Prefix>{ARCHIVE_PREFIX}</Prefix>"),
            F.col("rows"),
            F.lit("<IsTruncated>true</IsTruncated></ListBucketResult>"),
        ).alias("payload"),
    )


def archive_chain(spark, sf_dir: str) -> DataFrame:
    """Listing pages of twenty keys that name each other; some were never landed.

    Pages 3, 10, 17, ... are lost, pages 5, 16, 27, ... do not say what comes next,
    the second venue lost its first page, and one body in each venue is an error.
    """
    numbered = Window.partitionBy("venue").orderBy("page")
    entry = F.concat(F.lit(f"<CommonPrefixes><Prefix>{ARCHIVE_PREFIX}"), F.col("symbol"), F.lit("/</Prefix></CommonPrefixes>"))
    listed = _pages(fx.listings(spark, sf_dir).withColumn("row", entry), 20)
    chained = listed.withColumns({"nth": F.row_number().over(numbered), "next": F.lead("page").over(numbered)})
    says_next = F.col("next").isNotNull() & (F.col("nth") % 11 != 5)
    body = F.concat(
        F.lit(f"<ListBucketResult><Prefix>{ARCHIVE_PREFIX}</Prefix><Marker>"),
        F.when(F.col("nth") > 1, F.concat(F.lit("m"), F.col("page").cast("string"))).otherwise(""),
        F.lit("</Marker>"),
        F.when(says_next, F.concat(F.lit("<NextMarker>m"), F.col("next").cast("string"), F.lit("</NextMarker>"))).otherwise(""),
        F.col("rows"),
        F.when(F.col("next").isNull(), F.lit("<IsTruncated>false</IsTruncated>")).otherwise(F.lit("<IsTruncated>true</IsTruncated>")),
        F.lit("</ListBucketResult>"),
    )
    lost = (F.col("nth") % 7 == 3) | ((F.col("venue") == "beta") & (F.col("nth") == 1))
    broken = F.when(F.col("nth") == 2, F.lit("<Error><Code>SlowDown</Code></Error>")).otherwise(body)
    return chained.where(~lost).select("venue", broken.alias("payload"))


def _quotes(spark, sf_dir: str) -> DataFrame:
    """Best bid and ask per listed symbol; some books are empty or crossed."""
    ask = F.col("price") + ((F.col("size") - 5) * F.lit("0.05").cast("decimal(4,2)")).cast(
        "decimal(18,2)"
    )
    bid = F.when(F.col("key") % 50 == 0, F.lit("0.00").cast("decimal(18,2)")).otherwise(
        F.col("price")
    )
    return fx.listings(spark, sf_dir).select(
        "venue",
        "symbol",
        "canonical",
        "base",
        "size",
        "key",
        bid.cast("decimal(18,2)").cast("string").alias("bid"),
        ask.cast("decimal(18,2)").cast("string").alias("ask"),
    )


def tickers(spark, sf_dir: str) -> DataFrame:
    row = F.concat(
        F.lit('{"symbol":"'), F.col("symbol"), F.lit('","bidPrice":"'), F.col("bid"),
        F.lit('","askPrice":"'), F.col("ask"), F.lit('"}'),
    )
    return _pages(_quotes(spark, sf_dir).withColumn("row", row), 200).select(
        "venue",
        F.to_timestamp(F.lit("2001-11-05 12:00:00")).alias("as_of"),
        F.concat(F.lit("["), F.col("rows"), F.lit("]")).alias("payload"),
    )


def levels(spark, sf_dir: str) -> DataFrame:
    row = F.concat(
        _quoted(F.col("canonical")),
        F.lit(':{"a":["'), F.col("ask"), F.lit('","1","1.0"],"b":["'), F.col("bid"),
        F.lit('","1","1.0"]}'),
    )
    return _pages(_quotes(spark, sf_dir).withColumn("row", row), 100).select(
        "venue",
        F.to_timestamp(F.lit("2001-11-05 12:00:00")).alias("as_of"),
        F.concat(F.lit('{"error":[],"result":{'), F.col("rows"), F.lit("}}")).alias("payload"),
    )
