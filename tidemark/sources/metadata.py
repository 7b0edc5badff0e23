"""Instrument metadata from the two venue formats and the archive listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import ARCHIVE_PREFIX
from tidemark.functions import money
from tidemark.sources.envelopes import envelope_outcome

COLUMNS = (
    "venue",
    "symbol",
    "canonical",
    "base",
    "quote",
    "status",
    "tick_size",
    "lot_size",
    "min_notional",
)

_SYMBOL = """struct<
  symbols: array<struct<
    symbol: string, baseAsset: string, quoteAsset: string, status: string,
    filters: array<struct<
      filterType: string, tickSize: string, stepSize: string, minNotional: string>>>>>"""

_PAIRS = """struct<
  error: array<string>,
  result: map<string, struct<
    altname: string, wsname: string, status: string, tick_size: string,
    lot_decimals: int, costmin: string>>>"""


def _last_wins(parsed: DataFrame) -> DataFrame:
    """Later pages and later positions replace earlier ones for the same symbol.

    Rows without a symbol, such as pages that cannot be read, all stay.
    """
    rest = [name for name in parsed.columns if name not in ("venue", "symbol", "position")]
    named = (
        parsed.where(F.col("symbol").isNotNull())
        .groupBy("venue", "symbol")
        .agg(F.max_by(F.struct(*rest), "position").alias("kept"))
        .select("venue", "symbol", *[F.col(f"kept.{name}").alias(name) for name in rest])
    )
    return named.unionByName(parsed.where(F.col("symbol").isNull()).select("venue", "symbol", *rest))


def _junk(text: str, kind: str) -> Column:
    return money.parse_money(F.col(text), kind).isNull()


def _last_filter(kind: str):
    """The last filter of a kind; the list is a handful of entries per symbol."""
    found = F.filter("s.filters", lambda item: item["filterType"] == kind)
    return F.try_element_at(found, F.lit(-1))


def parse_symbols(payloads: DataFrame) -> DataFrame:
    """(venue, page, payload) symbol descriptions to metadata plus ``reason``.

    Halted symbols are kept: the venue describing them is the evidence that they
    existed.  A symbol that states no minimum order value has none, which is
    zero; a symbol without a tick or lot size, or with one that is no decimal, is
    malformed.  Every page that cannot be read leaves one row with a reason.
    """
    exploded = payloads.select(
        "venue",
        "page",
        F.posexplode_outer(F.from_json("payload", _SYMBOL)["symbols"]).alias("at", "s"),
    )
    parsed = exploded.select(
        "venue",
        F.col("s.symbol").alias("symbol"),
        F.struct("page", "at").alias("position"),
        F.lit(None).cast("string").alias("canonical"),
        F.col("s.baseAsset").alias("base"),
        F.col("s.quoteAsset").alias("quote"),
        F.col("s.status").alias("status"),
        _last_filter("PRICE_FILTER")["tickSize"].alias("tick_text"),
        _last_filter("LOT_SIZE")["stepSize"].alias("lot_text"),
        F.coalesce(
            _last_filter("NOTIONAL")["minNotional"],
            _last_filter("MIN_NOTIONAL")["minNotional"],
            F.lit("0"),
        ).alias("notional_text"),
    )
    return _last_wins(parsed).select(
        "venue",
        "symbol",
        "canonical",
        "base",
        "quote",
        "status",
        money.parse_money(F.col("tick_text"), money.PRICE).alias("tick_size"),
        money.parse_money(F.col("lot_text"), money.LOT).alias("lot_size"),
        money.parse_money(F.col("notional_text"), money.NOTIONAL).alias("min_notional"),
        F.when(F.col("symbol").isNull(), F.lit("page or symbol: not as described"))
        .when(F.col("tick_text").isNull(), F.lit("missing PRICE_FILTER.tickSize"))
        .when(F.col("lot_text").isNull(), F.lit("missing LOT_SIZE.stepSize"))
        .when(_junk("tick_text", money.PRICE), F.lit("PRICE_FILTER.tickSize: expected a decimal"))
        .when(_junk("lot_text", money.LOT), F.lit("LOT_SIZE.stepSize: expected a decimal"))
        .when(_junk("notional_text", money.NOTIONAL), F.lit("minNotional: expected a decimal"))
        .alias("reason"),
    )


def parse_pairs(payloads: DataFrame) -> DataFrame:
    """(venue, page, payload) pair descriptions to metadata plus ``reason``.

    A pair whose display name is absent or is not exactly ``BASE/QUOTE`` is
    skipped: splitting the concatenated name would be a guess.  A page that is a
    refusal or an outage is a row whose reason names which.
    """
    exploded = payloads.select(
        "venue",
        "page",
        envelope_outcome(F.col("payload")).alias("outcome"),
        F.posexplode_outer(F.map_entries(F.from_json("payload", _PAIRS)["result"])).alias(
            "at", "pair"
        ),
    )
    refused = exploded["pair"].isNull() & (F.col("outcome") != "ok")
    legs = F.split(F.col("pair.value.wsname"), "/")
    lot = money.power_of_ten(F.col("pair.value.lot_decimals"))
    parsed = exploded.where(F.col("pair").isNull() | (F.size(legs) == 2)).select(
        "venue",
        F.col("pair.value.altname").alias("symbol"),
        F.struct("page", "at").alias("position"),
        F.col("pair.key").alias("canonical"),
        F.get(legs, F.lit(0)).alias("base"),
        F.get(legs, F.lit(1)).alias("quote"),
        F.col("pair.value.status").alias("status"),
        money.parse_money(F.col("pair.value.tick_size"), money.PRICE).alias("tick_size"),
        lot.alias("lot_size"),
        money.parse_money(F.col("pair.value.costmin"), money.NOTIONAL).alias("min_notional"),
        F.when(refused, F.concat(F.lit("envelope: "), "outcome")).alias("fault"),
    )
    return _last_wins(parsed).withColumn(
        "reason",
        F.coalesce("fault", F.when(F.col("symbol").isNull(), F.lit("page or altname: not as described")))
    ).withColumn(
        "reason",
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("tick_size").isNull(), F.lit("tick_size: expected a decimal"))
        .when(F.col("lot_size").isNull(), F.lit("lot_decimals: outside what a lot can hold"))
        .when(F.col("min_notional").isNull(), F.lit("costmin: expected a decimal")),
    ).drop("fault")


def good_metadata(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).select(*COLUMNS)


def archive_symbols(pages: DataFrame, prefix: str = ARCHIVE_PREFIX) -> DataFrame:
    """(venue, payload) archive listing pages to the distinct symbols they name."""
    found = F.regexp_extract_all("payload", F.lit("<Prefix>(.*?)</Prefix>"), F.lit(1))
    name = F.trim(F.substr("entry", F.lit(len(prefix) + 1)), F.lit("/"))
    return (
        pages.select("venue", F.explode(found).alias("entry"))
        .where(F.col("entry").startswith(prefix))
        .select("venue", name.alias("symbol"))
        .where(F.length("symbol") > 0)
        .distinct()
    )


def archive_gaps(pages: DataFrame) -> DataFrame:
    """What is missing of each venue's archive listing: no row if its pages are complete.

    A listing is a chain: it begins with the page that has no marker, and a truncated
    page names the marker of the next.  A page nobody landed is a row with the marker
    it should have had and the page that named it; symbols of a listing with gaps are
    not all symbols.
    """
    tag = lambda name: F.trim(F.regexp_extract("payload", f"<{name}>(.*?)</{name}>", 1))
    read = pages.select(
        "venue",
        F.coalesce(F.col("payload").rlike("<ListBucketResult[ >]"), F.lit(False)).alias("is_page"),
        tag("Marker").alias("marker"),
        tag("NextMarker").alias("next"),
        F.coalesce(F.lower(tag("IsTruncated")) == "true", F.lit(False)).alias("truncated"),
    )
    listed = read.where("is_page")
    nothing = F.lit(None).cast("string")
    landed = listed.select("venue", F.col("marker").alias("next")).distinct()
    missing = (
        listed.where("truncated AND next <> ''")
        .groupBy("venue", "next")
        .agg(F.min("marker").alias("after"))
        .join(landed, ["venue", "next"], "left_anti")
        .select("venue", "after", F.col("next").alias("marker"), F.lit("page not landed").alias("reason"))
    )
    open_ended = listed.where("truncated AND next = ''").select(
        "venue", F.col("marker").alias("after"), nothing.alias("marker"), F.lit("truncated without a next marker").alias("reason")
    )
    headless = (
        read.groupBy("venue")
        .agg(F.count_if(F.col("is_page") & (F.col("marker") == "")).alias("first_pages"))
        .where("first_pages = 0")
        .select("venue", nothing.alias("after"), F.lit("").alias("marker"), F.lit("first page not landed").alias("reason"))
    )
    unread = read.where("NOT is_page").select(
        "venue", nothing.alias("after"), nothing.alias("marker"), F.lit("not a listing page").alias("reason")
    )
    return missing.unionByName(open_ended.distinct()).unionByName(headless).unionByName(unread)


def trading_summary(metadata: DataFrame, live: DataFrame) -> DataFrame:
    """Symbols described, trading and halted per venue; ``live`` is the profile table."""
    is_live = F.array_contains("live_statuses", F.col("status"))
    return (
        metadata.join(live, "venue")
        .groupBy("venue")
        .agg(
            F.count("*").alias("symbols"),
            F.count_if(is_live).alias("trading"),
            F.count_if(~is_live).alias("halted"),
        )
    )
