"""Scans, filters, scalar functions and parsers."""

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.plans.catalog import query
from tidemark.sources import parsers as P

AS_OF = 883612800000000  # 1998-01-01


@query(f"SELECT ticker, result, settled_us FROM settled WHERE settled_us < {AS_OF}", "settled")
def s01_as_of_scan(m):
    return m.settled.where(F.col("settled_us") < AS_OF).select("ticker", "result", "settled_us")


@query("SELECT c.ticker, period_us, bid, seq FROM candles c WHERE c.ticker IN (SELECT ticker FROM settled WHERE result = 'yes' AND o_totalprice > 200000)", "candles")
def s19_semi_join_load(m):
    keys = m.settled.where("result = 'yes' AND o_totalprice > 200000").select("ticker")
    return m.candles.join(keys, "ticker", "left_semi").select("ticker", "period_us", "bid", "seq")


@query("SELECT max(CASE WHEN event_type = 'view' THEN n END) AS views, coalesce(max(CASE WHEN event_type = 'refund' THEN n END), 7) AS refunds FROM (SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type)")
def s22_typed_parameters(m):
    pairs = m.raw("events").groupBy("event_type").agg(F.count("*").cast("string").alias("value"))
    wide = P.parameters(pairs, "event_type", "value", {"view": ("bigint", None), "refund": ("bigint", 7)})
    return wide.select(F.col("view").alias("views"), F.col("refund").alias("refunds"))


@query("SELECT ticker, period_us, seq, bid, ask, mid2, hours FROM observations", "observations")
def f01_quality_filter(m):
    return m.observations.select("ticker", "period_us", "seq", "bid", "ask", "mid2", "hours")


@query("SELECT series, CAST(count(*) AS BIGINT) AS n FROM settled WHERE series LIKE 'S1%' GROUP BY series", "settled")
def f04_series_prefix(m):
    return m.settled.where(F.col("series").like("S1%")).groupBy("series").agg(F.count("*").alias("n"))


@query(
    """SELECT ticker, period_us, seq, 'yes' AS side, (bid + ask) // 2 AS mid, ask - bid AS spread FROM candles
    WHERE bid > 0 AND ask > 0 AND ask - bid BETWEEN 0 AND 10 AND (bid + ask) // 2 BETWEEN 85 AND 97
    UNION ALL SELECT ticker, period_us, seq, 'no', CAST(floor((200 - bid - ask) / 2.0) AS INTEGER), ask - bid FROM candles
    WHERE bid > 0 AND ask > 0 AND ask - bid BETWEEN 0 AND 10 AND floor((200 - bid - ask) / 2.0) BETWEEN 85 AND 97""",
    "candles",
)
def f05_tails(m):
    return m.candles.select("ticker", "period_us", "seq", F.explode(X.tails(F.col("bid"), F.col("ask"))).alias("t")).select("ticker", "period_us", "seq", "t.*")


@query("SELECT ticker, seq, period_us, CASE WHEN mid2 >= 170 THEN mid2 ELSE 200 - mid2 END AS favorite2, CASE WHEN mid2 >= 170 THEN yes ELSE NOT yes END AS won FROM observations WHERE mid2 BETWEEN 170 AND 194 OR mid2 BETWEEN 6 AND 30", "observations")
def f07_favorite_space(m):
    price = F.round(X.favorite_price(F.col("mid")) * 200).cast("int")
    return m.observations.select("ticker", "seq", "period_us", price.alias("favorite2"), X.favorite_won(F.col("mid"), F.col("yes")).alias("won")).where("favorite2 IS NOT NULL")


@query(f"SELECT event_ticker, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (regexp_matches(ticker, '{X.STRIKE_SUFFIX}')) AS BIGINT) AS n_strikes FROM settled GROUP BY event_ticker HAVING n >= 2 AND n_strikes * 2 > n", "settled")
def f08_chains(m):
    strike = F.col("ticker").rlike(X.STRIKE_SUFFIX)
    return m.settled.groupBy("event_ticker").agg(F.count("*").alias("n"), F.count_if(strike).alias("n_strikes")).where("n >= 2 AND n_strikes * 2 > n")


@query(
    """SELECT s.event_ticker, count(DISTINCT s.ticker) AS markets, count(DISTINCT c.ticker) AS covered FROM settled s LEFT JOIN candles c ON s.ticker = c.ticker
    GROUP BY s.event_ticker HAVING count(DISTINCT s.ticker) >= 3 AND bool_or(result = 'yes') AND bool_or(result = 'no') AND count(DISTINCT c.ticker) >= greatest(0.5 * count(DISTINCT s.ticker), 3)""",
    "candles",
)
def f09_structural_chains(m):
    quoted = m.candles.select("ticker").distinct().withColumn("quoted", F.lit(True))
    joined = m.settled.join(quoted, "ticker", "left").groupBy("event_ticker").agg(F.count_distinct("ticker").alias("markets"), F.count_distinct(F.when(F.col("quoted"), F.col("ticker"))).alias("covered"), F.bool_or(F.col("result") == "yes").alias("y"), F.bool_or(F.col("result") == "no").alias("n"))
    return joined.where(F.col("y") & F.col("n") & (F.col("markets") >= 3) & (F.col("covered") >= F.greatest(F.col("markets") * 0.5, F.lit(3)))).select("event_ticker", "markets", "covered")


@query("SELECT o.ticker, o.period_us, o.seq FROM observations o WHERE hours BETWEEN 3 AND 720 AND ask > bid AND series NOT IN ('S3', 'S7') AND ticker NOT IN (SELECT ticker FROM settled WHERE o_totalprice < 50000)", "observations")
def f10_scan_eligible(m):
    traded = m.settled.where("o_totalprice < 50000").select("ticker")
    return m.observations.where(F.col("hours").between(3, 720) & (F.col("ask") > F.col("bid")) & ~F.col("series").isin("S3", "S7")).join(traded, "ticker", "left_anti").select("ticker", "period_us", "seq")


@query("SELECT event_ticker, CAST(count(*) AS BIGINT) AS n, min(split_part(ticker, '-', 1)) AS series, min(regexp_replace(ticker, '-[^-]*$', '')) AS event FROM settled GROUP BY event_ticker", "settled")
def x01_ticker_parts(m):
    return m.settled.groupBy("event_ticker").agg(F.count("*").alias("n"), F.min(X.series(F.col("ticker"))).alias("series"), F.min(X.event_of(F.col("ticker"))).alias("event"))


@query(
    """SELECT price_bucket, time_bucket, flow_bucket, fill_bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(mid2 // 10 AS INTEGER) AS price_bucket,
    CASE WHEN hours < 1 THEN '0-1h' WHEN hours < 3 THEN '1-3h' WHEN hours < 6 THEN '3-6h' WHEN hours < 12 THEN '6-12h' WHEN hours < 24 THEN '12-24h' ELSE '24h+' END AS time_bucket,
    CASE WHEN hours < 1 THEN '<1h' WHEN hours < 3 THEN '1-3h' WHEN hours < 6 THEN '3-6h' WHEN hours < 12 THEN '6-12h' WHEN hours < 24 THEN '12-24h' WHEN hours < 72 THEN '1-3d' ELSE '3-7d' END AS flow_bucket,
    CASE WHEN hours < 1 THEN '<1h' WHEN hours < 3 THEN '<3h' WHEN hours < 6 THEN '<6h' WHEN hours < 12 THEN '<12h' WHEN hours < 24 THEN '<24h' WHEN hours < 72 THEN '<72h' WHEN hours < 168 THEN '<168h' ELSE '>168h' END AS fill_bucket FROM observations) GROUP BY ALL""",
    "observations",
)
def x11_buckets(m):
    h = F.col("hours")
    return m.observations.select(X.price_bucket(F.col("mid")).alias("price_bucket"), X.report_time_bucket(h).alias("time_bucket"), X.flow_time_bucket(h).alias("flow_bucket"), X.fill_time_bucket(h).alias("fill_bucket")).groupBy("price_bucket", "time_bucket", "flow_bucket", "fill_bucket").agg(F.count("*").alias("n"))


@query(
    """SELECT bid, q AS quantity, CAST(CASE WHEN bid <= 0 OR bid >= 100 THEN 0 ELSE ceil(round(0.0175 * q * (bid / 100.0) * (1 - bid / 100.0) * 100, 9)) END AS INTEGER) AS maker,
    CAST(CASE WHEN bid <= 0 OR bid >= 100 THEN 0 ELSE ceil(round(0.07 * q * (bid / 100.0) * (1 - bid / 100.0) * 100, 9)) END AS INTEGER) AS taker FROM (SELECT DISTINCT bid FROM candles), range(1, 21) r(q)""",
    "candles",
)
def x19_fees(m):
    grid = m.candles.select("bid").distinct().withColumn("quantity", F.explode(F.sequence(F.lit(1), F.lit(20))))
    return grid.select("bid", F.col("quantity").cast("bigint").alias("quantity"), X.fee(F.col("bid"), F.col("quantity")).alias("maker"), X.fee(F.col("bid"), F.col("quantity"), X.TAKER_RATE).alias("taker"))


@query(
    """SELECT bid, arg_min(q, (f / q, q)) AS quantity FROM (SELECT bid, q, CASE WHEN bid >= 100 THEN 0 ELSE ceil(round(0.0175 * q * (bid / 100.0) * (1 - bid / 100.0) * 100, 9)) END AS f FROM (SELECT DISTINCT bid FROM candles), range(1, 26) r(q)) GROUP BY bid""",
    "candles",
)
def x20_best_fee_quantity(m):
    return m.candles.select("bid").distinct().select("bid", X.best_fee_quantity(F.col("bid"), 25).cast("bigint").alias("quantity"))


@query("SELECT ticker, seq, period_us, CAST(least(97, greatest(85, bid)) AS INTEGER) AS snapped, CASE WHEN volume = 0 THEN 'dead' WHEN volume BETWEEN 1 AND 100 THEN 'low' WHEN volume BETWEEN 101 AND 1000 THEN 'moderate' WHEN volume BETWEEN 1001 AND 10000 THEN 'active' ELSE 'high' END AS volume_bucket FROM candles", "candles")
def x15_snap_and_volume(m):
    return m.candles.select("ticker", "seq", "period_us", X.snap_tail(F.col("bid")).alias("snapped"), X.volume_bucket(F.col("volume")).alias("volume_bucket"))


@query(
    """SELECT trade_id, s.side, l.p AS price, CASE WHEN s.side = 'yes' AND taker_side = 'no' AND yes_cents <= l.p OR s.side = 'no' AND taker_side = 'yes' AND yes_cents >= 100 - l.p THEN count ELSE 0 END AS flow
    FROM tape, (VALUES ('yes'), ('no')) s(side), (VALUES (85), (90), (97)) l(p)""",
    "tape",
)
def x26_opposing_flow(m):
    sides, limits = F.explode(F.array(F.lit("yes"), F.lit("no"))), F.explode(F.array(F.lit(85), F.lit(90), F.lit(97)))
    grid = m.tape.withColumn("side", sides).withColumn("price", limits)
    return grid.select("trade_id", "side", "price", X.opposing_flow(F.col("side"), F.col("price"), F.col("yes_cents"), F.col("taker_side"), F.col("count")).alias("flow"))


@query("SELECT trade_id, ticker, ts_us, CAST(count AS INTEGER) AS count, yes_cents, 100 - yes_cents AS no_cents, taker_side FROM tape WHERE trade_id % 10 <> 0", "tape")
def p01_trades(m):
    """Trades from API text; every tenth lacks its id and drops."""
    wire = m.tape.select(F.to_json(F.struct(F.when(F.col("trade_id") % 10 != 0, F.col("trade_id").cast("string")).otherwise("").alias("trade_id"), "ticker", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_time"), F.format_string("%.2f", F.col("count").cast("double")).alias("count_fp"), F.format_string("%.4f", F.col("yes_cents") / 100).alias("yes_price_dollars"), F.format_string("%.4f", 1 - F.col("yes_cents") / 100).alias("no_price_dollars"), "taker_side")).alias("body"))
    return P.trades(wire, "body").select(F.col("trade_id").cast("bigint").alias("trade_id"), "ticker", F.unix_micros("created_time").alias("ts_us"), "count", "yes_cents", "no_cents", "taker_side")


@query("SELECT seq, period_us, bid, ask, volume FROM candles", "candles")
def p02_candles(m):
    """Half of the candles in the dollar format, half in the plain one."""
    cents = lambda c: F.struct(F.col(c).alias("open"), F.col(c).alias("close"), F.col(c).alias("high"), F.col(c).alias("low"))
    dollars = lambda c: F.struct(*[F.format_string("%.4f", F.col(c) / 100).alias(f"{f}_dollars") for f in ("open", "close", "high", "low")])
    second = F.floor(F.col("period_us") / 1_000_000).alias("end_period_ts")
    plain = F.to_json(F.struct(second, cents("bid").alias("yes_bid"), cents("ask").alias("yes_ask"), "volume"))
    new = F.to_json(F.struct(second, dollars("bid").alias("yes_bid"), dollars("ask").alias("yes_ask"), F.format_string("%.2f", F.col("volume").cast("double")).alias("volume_fp")))
    wire = m.candles.select("seq", F.when(F.col("seq") % 2 == 0, plain).otherwise(new).alias("body"))
    return P.candles(wire, "body", "seq").select("seq", F.unix_micros("period_end").alias("period_us"), F.col("yes_bid_close").alias("bid"), F.col("yes_ask_close").alias("ask"), "volume")


@query("SELECT ticker, max(bid) AS best_bid, 100 - max(100 - ask) AS best_ask, CAST(sum(volume) AS BIGINT) AS depth FROM candles WHERE ask <= 100 GROUP BY ticker", "candles")
def p04_ladders(m):
    book = m.candles.where("ask <= 100").groupBy("ticker").agg(F.collect_list(F.struct(F.col("bid").alias("price"), F.col("volume").alias("quantity"))).alias("yes"), F.collect_list(F.struct((100 - F.col("ask")).alias("price"), F.col("volume").alias("quantity"))).alias("no"))
    top = P.book_top(F.col("yes"), F.col("no"))
    return book.select("ticker", top["bid"].alias("best_bid"), top["ask"].alias("best_ask"), top["yes_depth"].cast("bigint").alias("depth"))


@query(
    """SELECT event_ticker, CASE WHEN n <= 1 THEN 'standalone' WHEN between_ THEN 'partition' WHEN mutex THEN 'partition' WHEN threshold THEN 'monotone' ELSE 'standalone' END AS structure FROM (
    SELECT event_ticker, count(*) AS n, bool_or(o_orderpriority = '1-URGENT') AS between_, bool_or(o_orderpriority = '5-LOW') AS mutex, bool_or(o_orderpriority = '2-HIGH') AS threshold FROM settled GROUP BY event_ticker)""",
    "settled",
)
def p09_market_structure(m):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "between").when(F.col("o_orderpriority") == "2-HIGH", "greater").otherwise("custom")
    events = m.settled.groupBy("event_ticker").agg(F.collect_list(F.struct(kind.alias("strike_type"), F.lit("active").alias("status"))).alias("markets"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("mutually_exclusive"))
    return events.select("event_ticker", P.market_structure(F.col("markets"), F.col("mutually_exclusive")).alias("structure"))


@query("SELECT DISTINCT 'SPXW' || '990101' || CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'P' END || lpad(CAST(p_size * 1000 AS VARCHAR), 8, '0') AS symbol, 'SPXW' AS root, CASE WHEN p_size % 2 = 0 THEN 'call' ELSE 'put' END AS kind, CAST(p_size AS DOUBLE) AS strike, 47117 AS expiry_day FROM part")
def p11_option_symbols(m):
    symbol = F.concat(F.lit("SPXW990101"), F.when(F.col("p_size") % 2 == 0, "C").otherwise("P"), F.lpad((F.col("p_size") * 1000).cast("string"), 8, "0"))
    parsed = P.option_symbol(F.col("symbol"))
    return m.raw("part").select(symbol.alias("symbol")).distinct().select("symbol", parsed["root"].alias("root"), parsed["kind"].alias("kind"), parsed["strike"].alias("strike"), F.datediff(parsed["expiry"], F.lit("1970-01-01")).alias("expiry_day"))


@query("SELECT event_id, CASE WHEN k >= 100 THEN 0 WHEN k > 90 THEN 0 WHEN k < 10 THEN 1 END AS winner FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def p15_outcomes(m):
    k = F.get_json_object("props", "$.k").cast("int")
    prices = F.array(k / 100, 1 - k / 100)
    return m.raw("events").select("event_id", P.winner(prices).alias("winner"))


@query("SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown' END AS kind, event_type NOT IN ('view', 'click') AS review, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def p19_enum_or_default(m):
    kind, review = P.known_or_default(F.col("event_type"), ("view", "click"), "unknown")
    return m.raw("events").select("event_type", kind.alias("kind"), review.alias("review")).groupBy("event_type", "kind", "review").agg(F.count("*").alias("n"))


@query("SELECT ticker, CAST(o_orderkey AS DOUBLE) AS strike FROM settled", "settled")
def p21_strikes(m):
    return m.settled.select("ticker", X.strike_of(F.col("ticker")).alias("strike"))
