"""FLT: predicates and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import instants as ts
from tidemark.functions import text
from tidemark.operators import listing, policy, quality
from tidemark.sources import bars, envelopes
from tidemark.workloads import fixtures as fx
from tidemark.workloads.edge import exact, month, stamp
from tidemark.workloads.registry import query
from tidemark.workloads.scan_queries import intraday_bars

_ISO = "'%Y-%m-%dT%H:%M:%S'"


@query(
    "flt_1_is_listed_at",
    """
    SELECT c.venue, strftime(r.as_of, '%Y-%m') AS month, c.symbol,
           c.listed_at <= r.as_of AND (c.delisted_at IS NULL OR r.as_of < c.delisted_at) AS listed
    FROM fx_calendar c JOIN fx_refresh r USING (venue) WHERE c.metadata_available""",
)
def is_listed_at(spark, sf_dir):
    grid = fx.market(spark, sf_dir).grid()
    listed = ts.is_listed(F.col("listed_at"), F.col("delisted_at"), F.col("as_of"))
    return grid.select("venue", month(), "symbol", listed.alias("listed"))


@query(
    "flt_2_closed_bar_guard",
    """
    SELECT venue, symbol, count(*) AS bars,
           count(*) FILTER (open_time + INTERVAL 1 DAY <= TIMESTAMP '2001-06-15 12:00:00') AS closed
    FROM fx_bars GROUP BY ALL
    HAVING count(*) FILTER (open_time + INTERVAL 1 DAY <= TIMESTAMP '2001-06-15 12:00:00') > 0""",
)
def closed_bar_guard(spark, sf_dir):
    """How many bars a default read keeps; that the strict guard fails the job is a unit test."""
    observed = F.to_timestamp(F.lit("2001-06-15 12:00:00"))
    flagged = fx.daily_bars(spark, sf_dir).withColumn(
        "is_closed", ts.close_time(F.col("open_time"), F.col("timeframe")) <= observed
    )
    return (
        flagged.groupBy("venue", "symbol")
        .agg(F.count("*").alias("bars"), F.count_if("is_closed").alias("closed"))
        .where("closed > 0")
    )


@query(
    "flt_3_close_time",
    f"""
    SELECT symbol, timeframe, count(*) AS bars,
           strftime(min(open_time + to_seconds(size)), {_ISO}) AS first_close,
           strftime(max(open_time + to_seconds(size)), {_ISO}) AS last_close
    FROM fx_intraday_bars GROUP BY ALL""",
)
def close_time(spark, sf_dir):
    closes = ts.close_time(F.col("open_time"), F.col("timeframe"))
    return intraday_bars(spark, sf_dir).groupBy("symbol", "timeframe").agg(
        F.count("*").alias("bars"),
        stamp(F.min(closes), "first_close"),
        stamp(F.max(closes), "last_close"),
    )


@query(
    "flt_4_listing_window_validity",
    """
    SELECT c_mktsegment AS segment, count(*) AS windows,
           count(*) FILTER (delisted_at <= listed_at) AS invalid,
           count(*) FILTER (delisted_at IS NULL) AS still_listed
    FROM (SELECT o_custkey, min(o_orderdate) FILTER (o_orderstatus = 'O') AS listed_at,
                 max(o_orderdate) FILTER (o_orderstatus = 'F') AS delisted_at
          FROM orders GROUP BY ALL) JOIN customer ON c_custkey = o_custkey
    WHERE listed_at IS NOT NULL GROUP BY ALL""",
)
def listing_window_validity(spark, sf_dir):
    """Windows from first open to last filled order; some end before they start."""
    windows = (
        fx.table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))).alias("listed_at"),
            F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("delisted_at"),
        )
        .where(F.col("listed_at").isNotNull())
    )
    owners = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")
    )
    invalid = listing.invalid_window(F.col("listed_at"), F.col("delisted_at"))
    return (
        windows.join(owners, "o_custkey")
        .groupBy("segment")
        .agg(
            F.count("*").alias("windows"),
            F.count_if(invalid).alias("invalid"),
            F.count_if(F.col("delisted_at").isNull()).alias("still_listed"),
        )
    )


@query(
    "flt_5_money_checks",
    """
    SELECT event_type, reason, count(*) AS rows, sum(good)::DECIMAL(34,2)::VARCHAR AS total FROM (
      SELECT event_type,
        CASE WHEN price IS NULL THEN 'not a finite decimal' WHEN price < 0 THEN 'below zero' ELSE 'ok' END AS reason,
        CASE WHEN price >= 0 THEN price::DECIMAL(18,2) END AS good
      FROM (SELECT event_type,
              TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'NaN' WHEN event_id % 11 = 0 THEN amount || 'x'
                            WHEN event_id % 13 = 0 THEN '-' || amount ELSE amount END AS DECIMAL(20,10)) AS price
            FROM (SELECT event_id, event_type, value::DECIMAL(18,2)::VARCHAR AS amount FROM events))) GROUP BY ALL""",
)
def money_checks(spark, sf_dir):
    """Price texts, some of them not numbers and some of them negative; minus nothing is not negative."""
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    raw = (
        F.when(F.col("event_id") % 7 == 0, F.lit("NaN"))
        .when(F.col("event_id") % 11 == 0, F.concat(amount, F.lit("x")))
        .when(F.col("event_id") % 13 == 0, F.concat(F.lit("-"), amount))
        .otherwise(amount)
    )
    checked = fx.table(spark, sf_dir, "events").select(
        "event_type", raw.alias("raw"), quality.price_fault(raw).alias("fault")
    )
    good = F.when(F.col("fault").isNull(), F.col("raw").try_cast("decimal(18,2)"))
    return checked.groupBy(
        "event_type", F.coalesce("fault", F.lit("ok")).alias("reason")
    ).agg(F.count("*").alias("rows"), exact(F.sum(good), 2, "total"))


@query(
    "flt_6_venue_slug",
    """
    SELECT name, count(*) AS rows, regexp_full_match(name, '[a-z][a-z0-9_]{1,31}') AS valid
    FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment
                 WHEN 2 THEN 'v_' || c_nationkey ELSE c_nationkey || 'v' END AS name FROM customer)
    GROUP BY ALL""",
)
def venue_slug(spark, sf_dir):
    kind = F.col("c_custkey") % 4
    name = (
        F.when(kind == 0, F.lower("c_mktsegment"))
        .when(kind == 1, F.col("c_mktsegment"))
        .when(kind == 2, F.concat(F.lit("v_"), F.col("c_nationkey").cast("string")))
        .otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit("v")))
    )
    return (
        fx.table(spark, sf_dir, "customer")
        .groupBy(name.alias("name"))
        .agg(F.count("*").alias("rows"))
        .withColumn("valid", quality.is_venue_slug(F.col("name")))
    )


@query(
    "flt_7_typed_payloads",
    """
    SELECT CASE event_id % 8 WHEN 1 THEN 'symbol: missing required key' WHEN 2 THEN 'symbol: expected string'
        WHEN 3 THEN 'size: expected integer' WHEN 4 THEN 'levels: expected array'
        WHEN 5 THEN 'payload: expected an object' WHEN 6 THEN 'payload: not JSON'
        ELSE 'ok' END AS reason, count(*) AS rows
    FROM events GROUP BY ALL""",
)
def typed_payloads(spark, sf_dir):
    """Objects rendered from events, with one kind of fault in most of them."""
    kind = F.col("event_id") % 8
    number = F.col("user_id").cast("string")
    symbol = F.concat(F.lit('"symbol":"'), F.col("event_type"), F.lit('",'))
    whole = lambda *parts: F.concat(F.lit("{"), *parts, F.lit("}"))
    size = F.concat(F.lit('"size":'), number, F.lit(","))
    levels = F.lit('"levels":[["1","2"]],"extra":{"k":1}')
    payload = (
        F.when(kind == 1, whole(size, levels))
        .when(kind == 2, whole(F.concat(F.lit('"symbol":'), number, F.lit(",")), size, levels))
        .when(kind == 3, whole(symbol, F.concat(F.lit('"size":"'), number, F.lit('",')), levels))
        .when(kind == 4, whole(symbol, size, F.lit('"levels":{"1":"2"},"extra":{"k":1}')))
        .when(kind == 5, F.concat(F.lit("["), number, F.lit("]")))
        .when(kind == 6, F.concat(F.lit("{"), number))
        .otherwise(whole(symbol, size, levels))
    )
    expected = [
        ("symbol", "string"),
        ("size", "integer"),
        ("levels", "array"),
        ("extra", "object"),
    ]
    fault = envelopes.payload_fault(F.col("payload"), expected)
    return (
        fx.table(spark, sf_dir, "events")
        .select(payload.alias("payload"))
        .select(F.coalesce(fault, F.lit("ok")).alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("rows"))
    )


@query(
    "flt_8_quote_scope",
    """
    SELECT venue, quote, count(*) AS symbols FROM fx_listing
    WHERE quote IN ('EUR', 'USD', 'USDT') GROUP BY ALL""",
)
def quote_scope(spark, sf_dir):
    scoped = fx.listings(spark, sf_dir).where(quality.in_scope(F.col("quote")))
    return scoped.groupBy("venue", "quote").agg(F.count("*").alias("symbols"))


@query(
    "flt_9_quote_policies",
    """
    SELECT venue, quote_policy, count(*) AS symbols
    FROM fx_listing JOIN fx_quote_policy USING (quote) GROUP BY ALL""",
)
def quote_policies(spark, sf_dir):
    """Nested policies in one pass: a symbol is counted under every policy it fits."""
    return (
        policy.fitting_quote_policies(fx.listings(spark, sf_dir))
        .groupBy("venue", "quote_policy")
        .agg(F.count("*").alias("symbols"))
    )


@query(
    "flt_10_is_trading",
    """
    SELECT venue, symbol, status = 'TRADING' AS is_trading FROM fx_listing""",
)
def is_trading(spark, sf_dir):
    return fx.listings(spark, sf_dir).join(fx.profiles(spark), "venue").select(
        "venue",
        "symbol",
        F.array_contains("live_statuses", F.col("status")).alias("is_trading"),
    )


@query(
    "flt_11_directly_verified",
    """
    SELECT venue, symbol, provenance,
           provenance IN ('venue_api', 'venue_archive', 'venue_announcement') AS verified FROM fx_calendar""",
)
def directly_verified(spark, sf_dir):
    return fx.market(spark, sf_dir).calendar.select(
        "venue",
        "symbol",
        "provenance",
        listing.directly_verified(F.col("provenance")).alias("verified"),
    )


@query(
    "flt_12_response_outcome",
    """
    SELECT venue, url, outcome, count(*) AS attempts FROM fx_journal GROUP BY ALL""",
)
def response_outcome(spark, sf_dir):
    return fx.journal(spark, sf_dir).groupBy("venue", "url", "outcome").agg(
        F.count("*").alias("attempts")
    )


@query(
    "flt_13_envelope_outcome",
    """
    SELECT event_type, CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'rejected'
        WHEN 3 THEN 'unavailable' ELSE 'malformed' END AS outcome, count(*) AS bodies
    FROM events GROUP BY ALL""",
)
def envelope_outcome(spark, sf_dir):
    """Failures inside successful responses; none of them reads as an empty result."""
    kind = F.col("event_id") % 6
    body = (
        F.when(
            kind == 0,
            F.concat(F.lit('{"error":[],"result":{"n":'), F.col("user_id").cast("string"), F.lit("}}")),
        )
        .when(kind == 1, F.lit('{"error":["EService:Busy"]}'))
        .when(kind == 2, F.lit('{"error":["EQuery:Invalid asset pair"]}'))
        .when(kind == 3, F.lit('{"error":["EQuery:Unknown","EAPI:Rate limit exceeded (x)"]}'))
        .when(kind == 4, F.lit('{"error":[]}'))
        .otherwise(F.lit('{"result":{}}'))
    )
    return (
        fx.table(spark, sf_dir, "events")
        .select("event_type", body.alias("body"))
        .groupBy("event_type", envelopes.envelope_outcome(F.col("body")).alias("outcome"))
        .agg(F.count("*").alias("bodies"))
    )


@query(
    "flt_14_venue_health",
    """
    SELECT venue, CASE WHEN last IN ('online') THEN 'operational'
        WHEN last IN ('cancel_only', 'post_only', 'limit_only') THEN 'degraded' ELSE 'unavailable' END AS health
    FROM (SELECT 'v_' || user_id AS venue, arg_max(CASE event_type WHEN 'click' THEN 'online'
            WHEN 'view' THEN 'online' WHEN 'purchase' THEN 'post_only' WHEN 'error' THEN 'maintenance'
            ELSE 'cancel_only' END, (ts, event_id)) AS last
          FROM events GROUP BY ALL)""",
)
def venue_health(spark, sf_dir):
    """Newest status text of every venue; one venue per user."""
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("click", "view"), F.lit("online"))
        .when(kind == "purchase", F.lit("post_only"))
        .when(kind == "error", F.lit("maintenance"))
        .otherwise(F.lit("cancel_only"))
    )
    newest = (
        fx.table(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("v_"), F.col("user_id").cast("string")).alias("venue"))
        .agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"))
    )
    return newest.select("venue", envelopes.venue_health(F.col("status")).alias("health"))


@query(
    "flt_15_recorded_responses",
    """
    SELECT CASE event_id % 7 WHEN 1 THEN 'regime: unknown label' WHEN 2 THEN 'confidence: outside 0..1'
        WHEN 3 THEN 'unexpected field' WHEN 4 THEN 'confidence: missing required key'
        WHEN 5 THEN 'not an object' ELSE 'valid' END AS reason, count(*) AS responses
    FROM events GROUP BY ALL""",
)
def recorded_responses(spark, sf_dir):
    kind = F.col("event_id") % 7
    share = F.concat(F.lit("0."), (F.col("user_id") % 10).cast("string"))
    response = (
        F.when(kind == 1, F.concat(F.lit('{"regime":"sideways","confidence":'), share, F.lit("}")))
        .when(kind == 2, F.lit('{"regime":"ranging","confidence":1.5}'))
        .when(
            kind == 3,
            F.concat(F.lit('{"regime":"ranging","stop_loss":1,"confidence":'), share, F.lit("}")),
        )
        .when(kind == 4, F.lit('{"regime":"ranging"}'))
        .when(kind == 5, F.lit("ranging"))
        .otherwise(
            F.concat(
                F.lit('{"regime":"trending_up","rationale":"calm","confidence":'), share, F.lit("}")
            )
        )
    )
    fault = envelopes.regime_response_fault(F.col("response"))
    return (
        fx.table(spark, sf_dir, "events")
        .select(response.alias("response"))
        .select(F.coalesce(fault, F.lit("valid")).alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("responses"))
    )


@query(
    "flt_15_recommendations",
    """
    SELECT CASE event_id % 9 WHEN 1 THEN 'action: unknown label' WHEN 2 THEN 'confidence: outside 0..1'
        WHEN 3 THEN 'unexpected field' WHEN 4 THEN 'strategy: missing required key' WHEN 5 THEN 'strategy: expected string'
        WHEN 6 THEN 'regime: unknown label' WHEN 7 THEN 'not an object' ELSE 'valid' END AS reason,
      event_type, count(*) AS responses
    FROM events GROUP BY ALL""",
)
def recommendations(spark, sf_dir):
    """Recorded recommendations; whatever sizes a position is not the model's to say."""
    kind = F.col("event_id") % 9
    share = F.concat(F.lit("0."), (F.col("user_id") % 10).cast("string"))
    body = (
        F.when(kind == 1, F.lit('"action":"buy","strategy":"momentum"'))
        .when(kind == 3, F.lit('"action":"long","strategy":"momentum","position_size":1'))
        .when(kind == 4, F.lit('"action":"short"'))
        .when(kind == 5, F.lit('"action":"flat","strategy":7'))
        .when(kind == 6, F.lit('"action":"flat","strategy":"carry","regime":"sideways"'))
        .when(kind == 8, F.lit('"action":"no_action","strategy":"carry","regime":"unknown","rationale":"calm"'))
        .otherwise(F.lit('"action":"long","strategy":"momentum"'))
    )
    confidence = F.when(kind == 2, F.lit("1.01")).otherwise(share)
    response = F.when(kind == 7, F.lit("[1]")).otherwise(
        F.concat(F.lit("{"), body, F.lit(',"confidence":'), confidence, F.lit("}"))
    )
    fault = envelopes.recommendation_fault(F.col("response"))
    return (
        fx.table(spark, sf_dir, "events")
        .select("event_type", response.alias("response"))
        .select("event_type", F.coalesce(fault, F.lit("valid")).alias("reason"))
        .groupBy("reason", "event_type")
        .agg(F.count("*").alias("responses"))
    )


#: Registered secrets for the redaction query; the last one is too short to count.
SECRETS = ("password", "password123", "licence", "license", "mention", "example", "the")


@query(
    "flt_16_many_secrets",
    """
    SELECT doc_id, md5(list_reduce(list_prepend(text, (SELECT list(w ORDER BY -length(w), w) FROM (
             SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{6,}')) AS w FROM benchmark))),
           lambda t, w: replace(t, w, '***REDACTED***'))) AS digest
    FROM documents""",
)
def many_secrets(spark, sf_dir):
    """Every longer word of the benchmark is a secret: one pass over whole texts."""
    words = F.explode(F.regexp_extract_all("text", F.lit("([a-z]{6,})")))
    # A register of secrets is a list somebody keeps; here one word each.
    register = [r["w"] for r in fx.table(spark, sf_dir, "benchmark").select(words.alias("w")).distinct().collect()]
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.redact_many(documents, register, ["text"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "flt_16_redaction",
    """
    SELECT doc_id, '***REDACTED***' AS api_token, source, lang,
           md5(replace(replace(replace(replace(replace(replace(text,
             'password123', '***REDACTED***'), 'password', '***REDACTED***'), 'example', '***REDACTED***'),
             'licence', '***REDACTED***'), 'license', '***REDACTED***'), 'mention', '***REDACTED***')) AS digest
    FROM documents""",
)
def redaction(spark, sf_dir):
    """Whole texts; the sensitive column is masked whatever it holds."""
    documents = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("api_token"), "source", "lang", "text"
    )
    return text.redact_frame(documents, SECRETS).select(
        "doc_id", "api_token", "source", "lang", F.md5(F.col("text").cast("binary")).alias("digest")
    )
