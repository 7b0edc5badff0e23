"""The fixture views once more, as SQL, for the side-by-side check."""

VIEWS: dict[str, str] = {}

VIEWS["fx_every_print"] = """
SELECT CASE WHEN n <= 15 THEN 'alpha' ELSE 'beta' END AS venue, p_brand AS symbol,
       l_shipdate AS ts, p_retailprice::DECIMAL(18,2) AS price,
       l_quantity::DECIMAL(18,2) AS qty, l_extendedprice::DECIMAL(18,2) AS quote_qty,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, n
FROM (SELECT *, CAST(substr(p_brand, 7) AS INT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

VIEWS["fx_prints"] = """
SELECT * FROM fx_every_print
WHERE NOT (n % 5 = 0 AND ts > TIMESTAMP '1999-06-30') AND NOT (n % 7 = 0 AND ts < TIMESTAMP '1997-03-15')
"""

VIEWS["fx_bars"] = """
SELECT venue, symbol, date_trunc('day', ts)::TIMESTAMP AS open_time,
       first(price ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
       max(price) AS high, min(price) AS low,
       last(price ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close,
       sum(qty)::DECIMAL(28,2) AS volume, sum(quote_qty)::DECIMAL(28,2) AS quote_volume
FROM fx_prints GROUP BY ALL
"""

VIEWS["fx_meta"] = """
SELECT CASE WHEN n <= 15 THEN 'alpha' ELSE 'beta' END AS venue, p_brand AS symbol, p_brand AS base,
       CASE n % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'USDT' END AS quote,
       CASE WHEN n % 5 = 0 THEN 'BREAK' ELSE 'TRADING' END AS status,
       CASE WHEN n % 2 = 0 THEN 0.001 ELSE 0.01 END::DECIMAL(10,3) AS lot_size,
       CASE WHEN n % 6 = 0 THEN 50 ELSE 10 END::DECIMAL(10,2) AS min_notional,
       CASE WHEN n % 2 = 0 THEN n * 2 END AS spread_bps
FROM (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INT) AS n FROM part)
"""

VIEWS["fx_extent"] = """
SELECT venue, symbol, min(open_time) AS first_open, max(open_time) AS last_open, count(*) AS bars
FROM fx_bars GROUP BY ALL
"""

VIEWS["fx_window"] = """
SELECT venue, min(first_open) AS observed_from, max(last_open) AS observed_to, count(*) AS series
FROM fx_extent GROUP BY ALL
"""

VIEWS["fx_calendar"] = """
SELECT venue, symbol, first_open AS listed_at,
       CASE WHEN status <> 'TRADING' THEN last_open + INTERVAL 1 DAY END AS delisted_at,
       CASE WHEN venue = 'beta' AND first_open <= observed_from + INTERVAL 1 DAY
            THEN 'unverified' ELSE 'reconstructed' END AS provenance,
       'venue status ''' || status || '''; ' ||
       CASE WHEN venue = 'beta' AND first_open <= observed_from + INTERVAL 1 DAY
            THEN 'first bar is on the edge of the servable window'
            ELSE 'listing instant is a lower bound' END AS note,
       TRUE AS metadata_available
FROM fx_extent JOIN fx_meta USING (venue, symbol) JOIN fx_window USING (venue)
UNION ALL
SELECT 'beta', symbol, TIMESTAMP '2013-01-01', delisted_at, 'venue_announcement',
       'announced delisting; listing instant unknown, membership is an upper bound', FALSE
FROM (VALUES ('Gone#1', TIMESTAMP '1998-05-01'), ('Gone#2', TIMESTAMP '2000-02-01')) t(symbol, delisted_at)
WHERE EXISTS (SELECT 1 FROM fx_bars WHERE venue = 'beta')
"""

VIEWS["fx_candidates"] = """
SELECT m.*, c.listed_at, c.delisted_at, c.provenance
FROM fx_meta m JOIN fx_calendar c USING (venue, symbol) WHERE c.metadata_available
"""

VIEWS["fx_refresh"] = """
SELECT venue, as_of::TIMESTAMP AS as_of FROM (
  SELECT venue, observed_from, observed_to,
         unnest(range(date_trunc('month', observed_from)::TIMESTAMP,
                      observed_to + INTERVAL 1 MICROSECOND, INTERVAL 1 MONTH)) AS as_of
  FROM fx_window)
WHERE as_of >= observed_from AND as_of <= observed_to
"""

VIEWS["fx_wstats"] = """
SELECT b.venue, b.symbol, r.as_of, count(*) AS observations,
       median(b.quote_volume::DECIMAL(28,4)) AS median_quote_volume
FROM fx_bars b JOIN fx_refresh r ON b.venue = r.venue
 AND b.open_time >= r.as_of - INTERVAL 30 DAY AND b.open_time <= r.as_of - INTERVAL 1 DAY
GROUP BY ALL
"""

VIEWS["fx_closes"] = """
SELECT b.venue, b.symbol, r.as_of, arg_max(b.close, b.open_time) AS close_as_of
FROM fx_bars b JOIN fx_refresh r ON b.venue = r.venue AND b.open_time <= r.as_of - INTERVAL 1 DAY
GROUP BY ALL
"""

VIEWS["fx_grid"] = """
SELECT c.* EXCLUDE (spread_bps), r.as_of, w.observations, w.median_quote_volume, p.close_as_of,
       CASE WHEN r.as_of = l.last_as_of THEN c.spread_bps END AS spread_bps,
       c.listed_at <= r.as_of AND (c.delisted_at IS NULL OR r.as_of < c.delisted_at) AS listed
FROM fx_candidates c
JOIN fx_refresh r USING (venue)
JOIN (SELECT venue, max(as_of) AS last_as_of FROM fx_refresh GROUP BY venue) l USING (venue)
LEFT JOIN fx_wstats w ON w.venue = c.venue AND w.symbol = c.symbol AND w.as_of = r.as_of
LEFT JOIN fx_closes p ON p.venue = c.venue AND p.symbol = c.symbol AND p.as_of = r.as_of
"""

VIEWS["fx_quote_policy"] = """
SELECT * FROM (VALUES ('EUR', 'EUR'), ('EUR+USD', 'EUR'), ('EUR+USD', 'USD'),
  ('EUR+USD+USDT', 'EUR'), ('EUR+USD+USDT', 'USD'), ('EUR+USD+USDT', 'USDT')) t(quote_policy, quote)
"""

VIEWS["fx_verdicts"] = """
SELECT *,
  listed AND v_quote_currency = 'admit' AND v_median_quote_volume = 'admit' AND v_asset_class = 'admit' AS in_liquidity,
  listed AND v_quote_currency = 'admit' AND v_median_quote_volume = 'admit' AND v_asset_class = 'admit'
    AND v_listing_age = 'admit' AS in_research,
  listed AND v_quote_currency = 'admit' AND v_median_quote_volume = 'admit' AND v_asset_class = 'admit'
    AND v_listing_age = 'admit' AND v_median_spread = 'admit' AS in_spread,
  listed AND v_quote_currency = 'admit' AND v_median_quote_volume = 'admit' AND v_asset_class = 'admit'
    AND v_listing_age = 'admit' AND v_min_notional_feasible = 'admit' AND v_lot_size_feasible = 'admit' AS in_executable
FROM (
  SELECT g.*, q.quote_policy,
    CASE WHEN EXISTS (SELECT 1 FROM fx_quote_policy x WHERE x.quote_policy = q.quote_policy AND x.quote = g.quote)
         THEN 'admit' ELSE 'reject' END AS v_quote_currency,
    CASE WHEN provenance = 'unverified' THEN 'not_evaluable'
         WHEN as_of >= listed_at + INTERVAL 180 DAY THEN 'admit' ELSE 'reject' END AS v_listing_age,
    CASE WHEN coalesce(observations, 0) < 20 OR median_quote_volume IS NULL THEN 'not_evaluable'
         WHEN median_quote_volume >= 75000 THEN 'admit' ELSE 'reject' END AS v_median_quote_volume,
    CASE WHEN spread_bps IS NULL THEN 'not_evaluable'
         WHEN spread_bps <= 25 THEN 'admit' ELSE 'reject' END AS v_median_spread,
    CASE WHEN min_notional <= 0 OR min_notional <= 46.875 THEN 'admit' ELSE 'reject' END AS v_min_notional_feasible,
    CASE WHEN close_as_of IS NULL THEN 'not_evaluable'
         WHEN lot_size * close_as_of <= 1.875 THEN 'admit' ELSE 'reject' END AS v_lot_size_feasible,
    CASE WHEN base IN ('Brand#4', 'Brand#9') THEN 'reject' ELSE 'admit' END AS v_asset_class
  FROM fx_grid g CROSS JOIN (SELECT DISTINCT quote_policy FROM fx_quote_policy) q)
"""

VIEWS["fx_missing"] = """
SELECT r.venue, r.as_of, count(c.symbol) AS known_missing
FROM fx_refresh r LEFT JOIN fx_calendar c ON c.venue = r.venue AND NOT c.metadata_available
 AND c.listed_at <= r.as_of AND r.as_of < c.delisted_at
GROUP BY ALL
"""

VIEWS["fx_monthly"] = """
SELECT v.venue, v.quote_policy, v.as_of, strftime(v.as_of, '%Y-%m') AS month, count(*) AS candidates,
  count(*) FILTER (in_liquidity) AS liquidity_size, count(*) FILTER (in_research) AS research_size,
  count(*) FILTER (in_spread) AS research_with_spread_size, count(*) FILTER (in_executable) AS executable_size,
  CASE WHEN count(*) FILTER (in_research) < 15 THEN 'too-thin'
       WHEN count(*) FILTER (in_research) <= 25 THEN 'low-power' ELSE 'ok' END AS power_band,
  count(*) FILTER (v_quote_currency = 'reject') AS rejected_quote_currency,
  count(*) FILTER (v_quote_currency = 'not_evaluable') AS unknown_quote_currency,
  count(*) FILTER (v_listing_age = 'reject') AS rejected_listing_age,
  count(*) FILTER (v_listing_age = 'not_evaluable') AS unknown_listing_age,
  count(*) FILTER (v_median_quote_volume = 'reject') AS rejected_median_quote_volume,
  count(*) FILTER (v_median_quote_volume = 'not_evaluable') AS unknown_median_quote_volume,
  count(*) FILTER (v_median_spread = 'reject') AS rejected_median_spread,
  count(*) FILTER (v_median_spread = 'not_evaluable') AS unknown_median_spread,
  count(*) FILTER (v_min_notional_feasible = 'reject') AS rejected_min_notional_feasible,
  count(*) FILTER (v_min_notional_feasible = 'not_evaluable') AS unknown_min_notional_feasible,
  count(*) FILTER (v_lot_size_feasible = 'reject') AS rejected_lot_size_feasible,
  count(*) FILTER (v_lot_size_feasible = 'not_evaluable') AS unknown_lot_size_feasible,
  count(*) FILTER (v_asset_class = 'reject') AS rejected_asset_class,
  count(*) FILTER (v_asset_class = 'not_evaluable') AS unknown_asset_class,
  any_value(m.known_missing) AS known_missing
FROM fx_verdicts v JOIN fx_missing m ON m.venue = v.venue AND m.as_of = v.as_of
GROUP BY v.venue, v.quote_policy, v.as_of
"""

VIEWS["fx_listed"] = """
SELECT c.*, r.as_of FROM fx_calendar c JOIN fx_refresh r ON r.venue = c.venue
WHERE c.listed_at <= r.as_of AND (c.delisted_at IS NULL OR r.as_of < c.delisted_at)
"""

VIEWS["fx_intraday"] = """
SELECT 'gamma' AS venue, event_type AS symbol, ts, value::DECIMAL(18,2) AS price,
       (user_id % 9 + 1)::DECIMAL(18,2) AS qty,
       value::DECIMAL(18,2) * (user_id % 9 + 1)::DECIMAL(4,0) AS quote_qty, event_id
FROM events
"""

VIEWS["fx_timeframe"] = """
SELECT * FROM (VALUES ('1m', 60), ('5m', 300), ('15m', 900), ('1h', 3600), ('4h', 14400), ('1d', 86400))
  t(timeframe, size)
"""

VIEWS["fx_intraday_bars"] = """
SELECT venue, symbol, timeframe, size,
       TIMESTAMP '1970-01-01' + to_seconds(epoch_us(ts) // (size::BIGINT * 1000000) * size) AS open_time,
       first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts, event_id) AS close, sum(qty)::DECIMAL(28,2) AS volume,
       sum(quote_qty)::DECIMAL(28,2) AS quote_volume
FROM fx_intraday CROSS JOIN fx_timeframe GROUP BY ALL
"""

VIEWS["fx_listing"] = """
SELECT CASE WHEN n <= 15 THEN 'alpha' ELSE 'beta' END AS venue, 'P' || p_partkey AS symbol,
       'XP' || p_partkey AS canonical, p_brand AS base,
       CASE p_size % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'USDT' ELSE 'BTC' END AS quote,
       CASE WHEN p_partkey % 5 = 0 THEN 'BREAK' ELSE 'TRADING' END AS status,
       p_partkey AS key, p_size AS size, p_retailprice::DECIMAL(18,2) AS price
FROM (SELECT *, CAST(substr(p_brand, 7) AS INT) AS n FROM part)
"""

VIEWS["fx_archive_page"] = """
SELECT *, NOT (nth % 7 = 3 OR (venue = 'beta' AND nth = 1)) AS landed
FROM (SELECT venue, page, row_number() OVER (PARTITION BY venue ORDER BY page) AS nth, count(*) OVER (PARTITION BY venue) AS pages
      FROM (SELECT DISTINCT venue, key // 20 AS page FROM fx_listing))
"""

VIEWS["fx_journal"] = """
SELECT *, CASE WHEN status IS NULL THEN 'transport_error' WHEN status BETWEEN 200 AND 299 THEN 'ok'
               WHEN status IN (408, 425, 429, 500, 502, 503, 504) THEN 'retryable' ELSE 'rejected' END AS outcome,
  CASE WHEN status = 200 THEN '' ELSE 'HTTP ' || coalesce(status::VARCHAR, 'none') END AS detail,
  CASE WHEN status = 200 THEN length(props) * 100 ELSE 0 END AS payload_bytes
FROM (
  SELECT CASE WHEN (event_id // 5) % 2 = 0 THEN 'alpha' ELSE 'beta' END AS venue,
    CASE WHEN (event_id // 5) % 3 = 0 THEN '/klines' ELSE '/ohlc' END AS url,
    'start=' || (event_id // 5) || '&symbol=Brand#' || ((event_id // 5) % 30 + 1) AS params,
    'Brand#' || ((event_id // 5) % 30 + 1) AS symbol, event_id // 5 AS request,
    ts AS requested_at, (event_id % 5 + 1)::INT AS attempt, props,
    CASE WHEN mix <= 4 THEN 200 WHEN mix <= 8 THEN 503 WHEN mix = 9 THEN 429 WHEN mix = 10 THEN 404
         WHEN mix <= 12 THEN 500 WHEN mix <= 15 THEN NULL ELSE 502 END AS status
  FROM (SELECT *, (event_id * 31 + user_id) % 17 AS mix FROM events))
"""

VIEWS["fx_finals"] = """
SELECT venue, url, params, any_value(symbol) AS symbol, any_value(request) AS request,
  max(attempt) AS attempts,
  CASE WHEN bool_or(outcome = 'ok') THEN 'ok' WHEN bool_or(outcome = 'rejected') THEN 'rejected'
       WHEN max(attempt) >= 5 THEN 'unavailable' ELSE 'pending' END AS final_outcome,
  arg_max(detail, (outcome = 'ok')::INT * 100 + (outcome = 'rejected')::INT * 10 + attempt) AS detail, max(requested_at) AS last_at
FROM fx_journal GROUP BY venue, url, params
"""
