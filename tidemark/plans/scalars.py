"""Column expressions over whole tables, each with its SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions import rules as R
from tidemark.operators import virtual as V
from tidemark.plans.catalog import query

FEE = "CASE WHEN {c} <= 0 OR {c} >= 100 THEN 0 ELSE CAST(ceil(round(0.0175 * {q} * ({c} / 100.0) * (1 - {c} / 100.0) * 100, 9)) AS INTEGER) END"


@query("SELECT ticker, regexp_replace(ticker, '-[^-]*$', '') AS event FROM settled", "settled")
def x02_event_of(m):
    return m.settled.select("ticker", X.event_of(F.col("ticker")).alias("event"))


@query("SELECT ticker, seq, round((settled_us - period_us) / 3.6e9, 6) AS hours FROM observations", "observations")
def x05_hours(m):
    hours = X.hours_between(F.timestamp_micros("period_us"), F.timestamp_micros("settled_us"))
    return m.observations.select("ticker", "seq", F.round(hours, 6).alias("hours"))


@query("SELECT CASE WHEN hours < 1 THEN '0-1h' WHEN hours < 3 THEN '1-3h' WHEN hours < 6 THEN '3-6h' WHEN hours < 12 THEN '6-12h' WHEN hours < 24 THEN '12-24h' ELSE '24h+' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT (trade_id % 400) / 10.0 AS hours FROM tape) GROUP BY ALL", "tape")
def x12_report_hours(m):
    return m.tape.groupBy(X.report_time_bucket((F.col("trade_id") % 400) / F.lit(10.0)).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN h < 1 THEN '<1h' WHEN h < 3 THEN '<3h' WHEN h < 6 THEN '<6h' WHEN h < 12 THEN '<12h' WHEN h < 24 THEN '<24h' WHEN h < 72 THEN '<72h' WHEN h < 168 THEN '<168h' ELSE '>168h' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT trade_id % 200 - 5 AS h FROM tape) GROUP BY ALL", "tape")
def x13_fill_hours(m):
    return m.tape.groupBy(X.fill_time_bucket((F.col("trade_id") % 200) - 5).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT bucket, CASE WHEN bucket IN ('<1h', '1-3h', '3-6h') THEN 'short' WHEN bucket IN ('6-12h', '12-24h') THEN 'medium' ELSE 'long' END AS coarse, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN h < 1 THEN '<1h' WHEN h < 3 THEN '1-3h' WHEN h < 6 THEN '3-6h' WHEN h < 12 THEN '6-12h' WHEN h < 24 THEN '12-24h' WHEN h < 72 THEN '1-3d' ELSE '3-7d' END AS bucket FROM (SELECT trade_id % 200 - 5 AS h FROM tape)) GROUP BY ALL", "tape")
def x14_flow_hours(m):
    fine = X.flow_time_bucket((F.col("trade_id") % 200) - 5)
    return m.tape.groupBy(fine.alias("bucket")).agg(F.count("*").alias("n")).withColumn("coarse", X.coarse_time_bucket(F.col("bucket")))


@query("SELECT trade_id, CAST(greatest(85, least(97, yes_cents)) AS INTEGER) AS snapped FROM tape", "tape")
def x16_snapped(m):
    return m.tape.select("trade_id", X.snap_tail(F.col("yes_cents")).cast("int").alias("snapped"))


@query("SELECT ticker, seq, round(CASE WHEN ask > bid THEN greatest(0.0, least(1.0, (50 - bid) / CAST(ask - bid AS DOUBLE))) ELSE 0.5 END, 9) AS yes, round(CASE WHEN ask > bid THEN (50 - (100 - ask)) / CAST(ask - bid AS DOUBLE) END, 9) AS no FROM candles", "candles")
def x17_relative_price(m):
    at = lambda side, clamp: F.round(X.relative_price(F.lit(50), F.col("bid"), F.col("ask"), F.lit(side), clamp), 9).alias(side)
    return m.candles.select("ticker", "seq", at("yes", True), at("no", False))


@query("SELECT ticker, seq, CAST(greatest(1, least(99, bid + CAST(round_even(0.3::DOUBLE * (ask - bid), 0) AS INTEGER))) AS INTEGER) AS lim FROM candles", "candles")
def x18_limit_at(m):
    return m.candles.select("ticker", "seq", X.limit_at(F.col("bid"), F.col("ask"), F.lit(0.3)).cast("int").alias("lim"))


@query("SELECT ticker, seq, round((mid - 0.5) / greatest(hours / 24.0, 1 / 48.0::DOUBLE), 9) AS per_day, round(CASE WHEN hours > 0 THEN (mid - 0.5) / (hours / 24.0) ELSE mid - 0.5 END, 9) AS no_floor FROM observations", "observations")
def x21_edge_per_day(m):
    edge, days = F.col("mid") - 0.5, F.col("hours") / F.lit(24.0)
    return m.observations.select("ticker", "seq", F.round(X.edge_per_day(edge, days), 9).alias("per_day"), F.round(R.ev_per_day(edge, days), 9).alias("no_floor"))


@query(f"SELECT trade_id, round(p * 0.3 * (100 - yes_cents - fee) - (1 - p) * 0.7 * (yes_cents + fee), 6) AS ev FROM (SELECT *, CASE WHEN taker_side = 'no' THEN 1 - 0.95::DOUBLE ELSE 0.95::DOUBLE END AS p, {FEE.format(c='yes_cents', q=1)} AS fee FROM tape)", "tape")
def x22_trade_ev(m):
    c = F.col("yes_cents")
    return m.tape.select("trade_id", F.round(X.trade_ev(F.lit(0.95), F.lit(0.3), F.lit(0.7), c, F.col("taker_side"), X.fee(c, F.lit(1))), 6).alias("ev"))


@query(f"SELECT trade_id, CAST(pnl AS BIGINT) AS pnl, round(pnl / CAST(yes_cents * count AS DOUBLE), 6) AS on_capital, round(yes_cents * count * greatest(trade_id % 9 / 4.0::DOUBLE, 1.0), 6) AS capital_days FROM (SELECT *, (CASE WHEN trade_id % 3 = 0 THEN 100 ELSE 0 END - yes_cents) * count - ({FEE.format(c='yes_cents', q='count')}) AS pnl FROM tape)", "tape")
def x23_returns(m):
    c, q = F.col("yes_cents"), F.col("count")
    pnl = X.pnl(c, F.when(F.col("trade_id") % 3 == 0, 100).otherwise(0), q, X.fee(c, q)).cast("bigint")
    return m.tape.select("trade_id", pnl.alias("pnl"), F.round(pnl / (c * q), 6).alias("on_capital"), F.round(X.capital_days(c, q, (F.col("trade_id") % 9) / F.lit(4.0)), 6).alias("capital_days"))


@query("SELECT trade_id, round(1 - ln(count) / ln(100), 9) AS y FROM tape", "tape")
def x24_log_linear(m):
    return m.tape.select("trade_id", F.round(X.log_linear(F.col("count"), F.lit(1), F.lit(1.0), F.lit(100), F.lit(0.0)), 9).alias("y"))


@query("SELECT trade_id, round(CASE WHEN q <= 0 THEN 1 WHEN q <= 1 THEN 0.9 WHEN q <= 5 THEN 0.9 - 0.1 * ln(q) / ln(5) WHEN q <= 10 THEN 0.8 - 0.2 * (ln(q) - ln(5)) / ln(2) WHEN q <= 20 THEN 0.6 - 0.2 * (ln(q) - ln(10)) / ln(2) WHEN q <= 40 THEN 0.4 ELSE 0 END, 9) AS p FROM (SELECT trade_id, count AS q FROM tape)", "tape")
def x25_cdf_lookup(m):
    """Thresholds up to 20 and too few observations to go on beyond: what the last gives, and 0 from over twice it."""
    at, exceed = (F.array(*[F.lit(v) for v in values]) for values in ((1, 5, 10, 20), (0.9, 0.8, 0.6, 0.4)))
    return m.tape.select("trade_id", F.round(X.cdf_lookup(at, exceed, F.col("count"), F.lit(100)), 9).alias("p"))


@query("SELECT trade_id AS order_id, round(ln(1 + count), 9) AS log_quantity, round(count / CAST(yes_cents + 1 AS DOUBLE), 9) AS size_ratio, CAST(hour(make_timestamp(ts_us)) AS INTEGER) AS hour, CAST(isodow(make_timestamp(ts_us)) - 1 AS INTEGER) AS weekday FROM tape", "tape")
def x28_model_features(m):
    rows = m.tape.select(F.col("trade_id").alias("order_id"), F.col("count").alias("quantity"), F.col("yes_cents").alias("depth"), F.col("ts_us").alias("placed_us"))
    return V.model_features(rows).select("order_id", F.round("log_quantity", 9).alias("log_quantity"), F.round("size_ratio", 9).alias("size_ratio"), F.col("hour").cast("int").alias("hour"), F.col("weekday").cast("int").alias("weekday"))


@query("SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS INTEGER) AS code FROM events")
def x29_enum_codes(m):
    return m.raw("events").select("event_id", R.enum_code(F.col("event_type"), ["view", "click", "purchase"]).alias("code"))


@query("SELECT event_id, CAST(round(CAST(value AS DECIMAL(30,9)), 1) AS DOUBLE) AS rounded FROM events")
def x31_rounded(m):
    return m.raw("events").select("event_id", R.rounded(F.col("value"), 1).alias("rounded"))


BETA_SQL = """t AS (SELECT x, CASE WHEN x <= 0.5 THEN x ELSE 1 - x END AS y, CASE WHEN x <= 0.5 THEN 1.45::DOUBLE ELSE 1.42::DOUBLE END AS a, CASE WHEN x <= 0.5 THEN 1.42::DOUBLE ELSE 1.45::DOUBLE END AS b FROM (SELECT i / 100.0::DOUBLE AS x FROM range(1, 100) r(i))),
s AS (SELECT x, any_value(pow(y, a)) * sum(gamma(k + 1 - b) / gamma(1 - b) / gamma(k + 1) * pow(y, k) / (a + k)) / (gamma(1.45) * gamma(1.42) / gamma(2.87)) AS v FROM t, range(0, 60) r(k) GROUP BY x),
beta AS (SELECT CAST(round(x * 100) AS INTEGER) AS pct, CASE WHEN x <= 0.5 THEN v ELSE 1 - v END AS v FROM s)"""


@query(f"WITH {BETA_SQL} SELECT trade_id, round(v, 9) AS p FROM tape JOIN beta ON yes_cents = pct", "tape")
def x33_incomplete_beta(m):
    return m.tape.select("trade_id", F.round(R.incomplete_beta(F.col("yes_cents") / F.lit(100.0)), 9).alias("p"))


@query(f"WITH {BETA_SQL} SELECT trade_id, round((1 - v) * 100 - yes_cents, 6) AS yes_edge, round(v * 100 - (100 - yes_cents), 6) AS no_edge FROM tape JOIN beta ON 100 - yes_cents = pct", "tape")
def m09_pit_edges(m):
    c = F.col("yes_cents")
    return m.tape.select("trade_id", F.round(R.pit_edge(c, "yes"), 6).alias("yes_edge"), F.round(R.pit_edge(c, "no"), 6).alias("no_edge"))


@query("SELECT e.key AS k, CAST(count(*) AS BIGINT) AS n, CAST(sum(e.value) AS BIGINT) AS total FROM (SELECT unnest(map_entries(CAST(props AS JSON)::MAP(VARCHAR, BIGINT))) AS e FROM events) GROUP BY ALL")
def x36_map_entries(m):
    each = m.raw("events").select(F.explode(F.from_json("props", "map<string,bigint>")).alias("k", "v"))
    return each.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT p_partkey, regexp_matches(p_brand, '^[a-z_][a-z0-9_.]*$') AS brand, regexp_matches(lower(replace(p_brand, '#', '_')), '^[a-z_][a-z0-9_.]*$') AS quoted FROM part")
def f14_identifiers(m):
    quoted = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
    return m.raw("part").select("p_partkey", R.is_identifier(F.col("p_brand")).alias("brand"), R.is_identifier(quoted).alias("quoted"))


@query("SELECT gp, CAST(round(mid * 20) AS INTEGER) AS bucket, count(DISTINCT ticker) AS markets, round(sqrt(avg(CAST(yes AS INTEGER)) * (1 - avg(CAST(yes AS INTEGER))) / count(DISTINCT ticker)), 9) AS se FROM observations GROUP BY ALL", "observations")
def a06_standard_errors(m):
    by = m.observations.groupBy("gp", F.round(F.col("mid") * 20).cast("int").alias("bucket")).agg(F.count_distinct("ticker").alias("markets"), F.avg(F.col("yes").cast("int")).alias("p"))
    return by.select("gp", "bucket", "markets", F.round(X.binomial_se(F.col("p"), F.col("markets")), 9).alias("se"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN d > 0.9 AND t < 0.1 THEN 0 WHEN t > 0.9 AND d < 0.1 THEN 1 END AS outcome FROM (SELECT *, l_quantity / 50 AS d, 1 - l_quantity / 50 AS t FROM lineitem)")
def p16_clean_resolutions(m):
    d = F.col("l_quantity") / 50
    return m.raw("lineitem").select("l_orderkey", "l_linenumber", R.clean_resolution(d, 1 - d).alias("outcome"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice > 0 AND l_discount > 0 THEN l_extendedprice / l_discount END, 3) AS price FROM lineitem")
def p17_prices_of_amounts(m):
    return m.raw("lineitem").select("l_orderkey", "l_linenumber", F.round(R.price_of_amounts(F.col("l_extendedprice"), F.col("l_discount")), 3).alias("price"))


@query("SELECT ticker, seq, round((ask - bid) / ((ask + bid) / 2.0) * 10000, 6) AS bps FROM candles", "candles")
def p14_spread_bps(m):
    return m.candles.select("ticker", "seq", F.round(R.spread_bps(F.col("ask"), F.col("bid")), 6).alias("bps"))


@query("SELECT p_partkey, TRY_CAST(p_brand AS DOUBLE) AS whole, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS part FROM part")
def p12_safe_casts(m):
    return m.raw("part").select("p_partkey", F.col("p_brand").try_cast("double").alias("whole"), F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("int").alias("part"))


@query("SELECT page_id, substr(html, 1, 200) AS title, length(substr(html, 1, 200)) AS n FROM pages")
def p05_event_fields(m):
    title = F.substring("html", 1, 200)
    return m.raw("pages").select("page_id", title.alias("title"), F.length(title).cast("bigint").alias("n"))


@query("SELECT ticker, nullif(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE result END, '') AS result, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END, o_orderkey) AS volume FROM settled", "settled")
def p06_market_fields(m):
    """The field with the suffix where it is there, and an empty result as none."""
    given = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("result"))
    return m.settled.select("ticker", F.nullif(given, F.lit("")).alias("result"), F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice")), F.col("o_orderkey")).alias("volume"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END, CAST(user_id AS VARCHAR)) AS fill_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, 'unknown') AS side, CAST(coalesce(CASE WHEN event_id % 5 > 0 THEN floor(value) END, 0) AS BIGINT) AS count FROM events")
def p22_fills(m):
    e = F.col("event_id")
    return m.raw("events").select("event_id", F.coalesce(F.when(e % 2 == 0, e.cast("string")), F.col("user_id").cast("string")).alias("fill_id"), F.coalesce(F.when(e % 3 == 0, F.col("event_type")), F.lit("unknown")).alias("side"), F.coalesce(F.when(e % 5 > 0, F.floor("value")), F.lit(0)).cast("bigint").alias("count"))


@query("SELECT event_id, CASE WHEN v > 0 AND event_id % 7 > 0 THEN CAST(round_even(v * 100, 0) AS INTEGER) END AS bid, CASE WHEN v > 0 AND event_id % 7 > 0 THEN CAST(round_even((v + 0.01) * 100, 0) AS INTEGER) END AS ask, round(event_id % 100 / 24.0::DOUBLE, 6) AS days FROM (SELECT *, floor(value) / 100 AS v FROM events)")
def q36_days_and_prices(m):
    e = m.raw("events").withColumn("v", F.floor("value") / 100)
    quote = R.cents_or_null(F.when(F.col("event_id") % 7 > 0, F.col("v")).otherwise(0.0), F.col("v") + 0.01)
    return e.select("event_id", quote["bid"].alias("bid"), quote["ask"].alias("ask"), F.round(F.col("event_id") % 100 / F.lit(24.0), 6).alias("days"))


@query("SELECT user_id, CAST(1000 - sum(CASE WHEN event_type = 'purchase' THEN floor(value) ELSE 0 END) AS BIGINT) AS available, CAST(sum(CASE WHEN event_type = 'purchase' THEN floor(value) ELSE 0 END) AS BIGINT) AS in_orders FROM events GROUP BY user_id")
def q37_capital(m):
    """Capital in orders, and the balance less it."""
    locked = F.sum(F.when(F.col("event_type") == "purchase", F.floor("value")).otherwise(0))
    return m.raw("events").groupBy("user_id").agg((1000 - locked).cast("bigint").alias("available"), locked.cast("bigint").alias("in_orders"))


@query("SELECT ticker, seq, ask <= 40 AS yes, 100 - bid <= 40 AS no FROM candles", "candles")
def q30_legacy_touches(m):
    t = lambda s: R.legacy_touch(F.lit(s), F.lit(40), F.col("bid"), F.col("ask"))
    return m.candles.select("ticker", "seq", t("yes").alias("yes"), t("no").alias("no"))


@query("SELECT trade_id, CAST(CASE WHEN trade_id % 5 = 0 THEN 0 WHEN trade_id % 3 = 0 THEN 1 WHEN trade_id % 2 = 0 THEN 2 END AS INTEGER) AS source, CAST(CASE WHEN trade_id % 5 = 0 THEN 10 WHEN trade_id % 3 = 0 THEN 20 WHEN trade_id % 2 = 0 THEN yes_cents END AS INTEGER) AS value FROM tape", "tape")
def q32_estimates_by_order(m):
    t = F.col("trade_id")
    best = R.estimate_by_order(F.when(t % 5 == 0, 10), F.when(t % 3 == 0, 20), F.when(t % 2 == 0, F.col("yes_cents")))
    return m.tape.select("trade_id", best["source"].alias("source"), best["value"].alias("value"))


@query("SELECT trade_id, count AS filled, ts_us + 3600000000 - ts_us % 3600000000 AS filled_us FROM tape", "tape")
def q34_instant_fills(m):
    """All of an order, at the next hourly period."""
    return m.tape.select("trade_id", F.col("count").alias("filled"), (F.col("ts_us") + 3_600_000_000 - F.col("ts_us") % 3_600_000_000).alias("filled_us"))


@query("SELECT event_type, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) ELSE 'public' END AS schema_name, CASE WHEN contains(name, '.') THEN split_part(name, '.', 2) ELSE name END AS table_name, n FROM (SELECT event_type, CASE WHEN event_type < 'p' THEN 'raw.' || event_type ELSE event_type END AS name, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type)")
def q47_qualified_names(m):
    by = m.raw("events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("name", F.when(F.col("event_type") < "p", F.concat(F.lit("raw."), "event_type")).otherwise(F.col("event_type")))
    part = lambda i: F.split_part("name", F.lit("."), F.lit(i))
    dotted = F.col("name").contains(".")
    return by.select("event_type", F.when(dotted, part(1)).otherwise("public").alias("schema_name"), F.when(dotted, part(2)).otherwise(F.col("name")).alias("table_name"), "n")


@query("SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, event_type) AS INTEGER) AS place FROM (SELECT DISTINCT user_id, event_type FROM events)")
def o03_case_order(m):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    order = Window.partitionBy("user_id").orderBy(rank, "event_type")
    return m.raw("events").select("user_id", "event_type").distinct().withColumn("place", F.row_number().over(order))


@query("SELECT event_ticker, ticker, CAST(row_number() OVER (PARTITION BY event_ticker ORDER BY floor(o_totalprice / 100) DESC, o_orderkey) AS INTEGER) AS place FROM settled", "settled")
def o07_by_value_stable(m):
    order = Window.partitionBy("event_ticker").orderBy(F.floor(F.col("o_totalprice") / 100).desc(), "o_orderkey")
    return m.settled.select("event_ticker", "ticker", F.row_number().over(order).alias("place"))


@query("SELECT event_ticker, ticker, CAST(row_number() OVER (PARTITION BY event_ticker ORDER BY md5('42|' || o_orderkey)) AS INTEGER) AS place FROM settled", "settled")
def o08_seeded_shuffle(m):
    """An order drawn by a seed, the same in every run."""
    order = Window.partitionBy("event_ticker").orderBy(F.md5(F.concat(F.lit("42|"), F.col("o_orderkey").cast("string")).cast("binary")))
    return m.settled.select("event_ticker", "ticker", F.row_number().over(order).alias("place"))


@query("SELECT ticker, seq, CASE WHEN volume > 0 THEN least(greatest(CAST(floor(volume * 0.1) AS INTEGER), 1), 3) ELSE 0 END AS fillable FROM candles", "candles")
def m02_fillable(m):
    return m.candles.select("ticker", "seq", X.fillable(F.col("volume"), F.lit(3), 0.1, 1).cast("int").alias("fillable"))


@query("SELECT ticker, seq, CASE WHEN bid > 0 AND ask > 0 AND ask - bid BETWEEN 0 AND 15 AND (bid + ask) // 2 BETWEEN 85 AND 97 THEN 'yes' END AS high_side, CAST(ask - bid AS INTEGER) AS spread FROM candles", "candles")
def f06_candle_tails(m):
    """The form for a candle's high bid and low ask: spreads up to 15."""
    found = X.tails(F.col("bid"), F.col("ask"), 15)
    return m.candles.select("ticker", "seq", F.when(F.exists(found, lambda t: t["side"] == "yes"), "yes").alias("high_side"), (F.col("ask") - F.col("bid")).cast("int").alias("spread"))


@query(f"SELECT trade_id, CAST(entry AS INTEGER) AS entry, CAST((CASE WHEN won THEN 100 - entry ELSE -entry END) * count - ({FEE.format(c='entry', q='count')}) AS BIGINT) AS pnl FROM (SELECT trade_id, count, trade_id % 2 = 0 AS won, CASE WHEN trade_id % 3 = 0 THEN yes_cents WHEN trade_id % 3 = 1 THEN 50 ELSE CAST(floor(user_id * 100 / count) AS INTEGER) % 100 END AS entry FROM (SELECT *, user_id % 20 AS x FROM tape))", "tape")
def r07_settlement_pnl(m):
    """The entry price is the fill's, else the resting order's, else from the exposure."""
    third = F.col("trade_id") % 3
    entry = F.when(third == 2, R.entry_price(F.lit(0), F.lit(0), F.col("user_id"), F.col("count")) % 100).otherwise(R.entry_price(F.when(third == 0, F.col("yes_cents")).otherwise(0), F.lit(50), F.col("user_id"), F.col("count")))
    priced = m.tape.withColumn("entry", entry.cast("int"))
    exit_ = F.when(F.col("trade_id") % 2 == 0, 100).otherwise(0)
    return priced.select("trade_id", "entry", X.pnl(F.col("entry"), exit_, F.col("count"), X.fee(F.col("entry"), F.col("count"))).cast("bigint").alias("pnl"))
