"""Smaller operators, each on its own."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.ml import boosted as B
from tidemark.operators import calibration as C
from tidemark.operators import joins as J
from tidemark.operators import sinks as K
from tidemark.operators import track as T
from tidemark.plans.catalog import query
from tidemark.sources import parsers as P

AS_OF = 883612800000000


@query(f"SELECT ticker, period_us, seq FROM candles WHERE period_us <= {AS_OF} AND (origin <> 'R' OR period_us + 8640000000000 > {AS_OF})", "candles")
def f03_known_at(m):
    """Rows recorded by a time and not superseded by then."""
    superseded = F.when(F.col("origin") == "R", F.col("period_us") + 8_640_000_000_000)
    return m.candles.where((F.col("period_us") <= AS_OF) & (superseded.isNull() | (superseded > AS_OF))).select("ticker", "period_us", "seq")


@query("SELECT ticker, period_us, seq, hours FROM observations WHERE hours BETWEEN 0 AND 48", "observations")
def f11_horizon(m):
    return m.observations.where(F.col("hours").between(0, 48)).select("ticker", "period_us", "seq", "hours")


@query("SELECT ticker, settled_us FROM settled WHERE settled_us >= 883612800000000 AND result IS NULL", "settled")
def f12_active_by_end(m):
    return m.settled.where((F.timestamp_micros("settled_us") >= F.lit("1998-01-01").cast("timestamp")) & F.col("result").isNull()).select("ticker", "settled_us")


@query("SELECT ticker, seq, period_us FROM candles WHERE NOT (bid > 60 AND ask > 65)", "candles")
def f13_maker_only(m):
    rows = m.candles.withColumn("would_cross_spread", (F.col("bid") > 60) & (F.col("ask") > 65))
    return rows.where(~F.col("would_cross_spread")).select("ticker", "seq", "period_us")


@query("SELECT s.ticker, c.period_us, c.bid FROM settled s JOIN (SELECT ticker, period_us, bid, row_number() OVER (PARTITION BY ticker ORDER BY period_us DESC, seq DESC) AS rn FROM (SELECT c.*, s.settled_us FROM candles c JOIN settled s ON c.ticker = s.ticker) WHERE period_us // 86400000000 < settled_us // 86400000000) c ON s.ticker = c.ticker AND rn = 1", "candles")
def j04_asof_by_date(m):
    day = lambda c: F.floor(F.col(c) / 86_400_000_000)
    left = m.settled.select("ticker", day("settled_us").alias("day"))
    right = m.candles.withColumn("quote_day", day("period_us")).withColumn("at_us", F.col("period_us"))
    out = J.asof_last(left, right, "ticker", "day", "quote_day", ["at_us", "bid"], tie=["at_us", "seq"])
    return out.where("matched_at IS NOT NULL").select("ticker", F.col("at_us").alias("period_us"), "bid")


@query("SELECT ticker, seq, period_us FROM candles WHERE split_part(ticker, '-', 1) IN ('S1', 'S2', 'S9')", "candles")
def j13_key_list(m):
    return m.candles.where(X.series(F.col("ticker")).isin("S1", "S2", "S9")).select("ticker", "seq", "period_us")


@query("SELECT CAST(floor(fav / 10) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(won AS INTEGER)) AS BIGINT) AS n_won FROM (SELECT CASE WHEN mid2 >= 170 THEN mid2 ELSE 200 - mid2 END AS fav, CASE WHEN mid2 >= 170 THEN yes ELSE NOT yes END AS won FROM observations WHERE mid2 BETWEEN 170 AND 194 OR mid2 BETWEEN 6 AND 30) GROUP BY 1", "observations")
def a02_favorite_stats(m):
    rows = m.observations.select(F.round(X.favorite_price(F.col("mid")) * 200).alias("fav"), X.favorite_won(F.col("mid"), F.col("yes")).alias("won")).where("fav IS NOT NULL")
    return rows.groupBy(F.floor(F.col("fav") / 10).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if("won").alias("n_won"))


@query("SELECT series, CAST(count(*) AS BIGINT) AS n FROM settled GROUP BY series HAVING count(*) > 50", "settled")
def a10_having(m):
    return m.settled.groupBy("series").agg(F.count("*").alias("n")).where("n > 50").orderBy(F.col("n").desc())


@query("SELECT o_orderpriority AS strike_type, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM settled GROUP BY o_orderpriority", "settled")
def a13_strike_types(m):
    return m.settled.groupBy(F.col("o_orderpriority").alias("strike_type")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


TRADES = "SELECT o_orderkey AS id, series, (85 + o_orderkey % 13) AS entry, result = 'yes' AS won, (o_orderkey % 10) / 100.0::DOUBLE AS edge FROM settled WHERE result IS NOT NULL"


def _trades(m):
    entry, won = 85 + F.col("o_orderkey") % 13, F.col("result") == "yes"
    return m.settled.where("result IS NOT NULL").select(F.col("o_orderkey").alias("id"), "series", entry.alias("entry"), won.alias("won"), (F.col("o_orderkey") % 10 / F.lit(100.0)).alias("edge"), F.lit(1).alias("contracts"), X.pnl(entry, F.when(won, 100).otherwise(0), F.lit(1), F.lit(0)).alias("pnl"))


@query(f"SELECT series, CAST(count(*) AS BIGINT) AS n, round(avg(edge), 9) AS promised, round(avg((CASE WHEN won THEN 100 ELSE 0 END - entry) / 100.0::DOUBLE), 9) AS realized FROM ({TRADES}) WHERE edge > 0 GROUP BY series", "settled")
def a22_edge_capture(m):
    return T.edge_capture(_trades(m), ["series"]).select("series", "n", F.round("promised", 9).alias("promised"), F.round("realized", 9).alias("realized"))


@query(f"SELECT series, CAST(count(*) AS BIGINT) AS n, round(avg(edge), 9) AS predicted, round(avg(CAST(won AS INTEGER)), 9) AS observed, round(avg(abs(edge - CAST(won AS INTEGER))), 9) AS mae FROM ({TRADES}) GROUP BY series", "settled")
def a26_predictions_by_key(m):
    out = B.by_group(_trades(m).withColumn("predicted", F.col("edge")), "series", "won")
    return out.select("series", "n", *[F.round(c, 9).alias(c) for c in ("predicted", "observed", "mae")])


@query(f"SELECT round(avg(abs(entry - m)), 6) AS baseline_mae FROM (SELECT entry, avg(entry) OVER (PARTITION BY series) AS m FROM ({TRADES}))", "settled")
def a25_baseline(m):
    return B.baseline_error(_trades(m), ["series"], "entry").select(F.round("baseline_mae", 6).alias("baseline_mae"))


@query(f"SELECT series, won, entry, CAST(count(*) AS BIGINT) AS n FROM ({TRADES}) GROUP BY series, won, entry QUALIFY row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, entry, won) <= 3", "settled")
def a33_top_by_count(m):
    counts = _trades(m).groupBy("series", "won", "entry").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("series").orderBy(F.col("n").desc(), "entry", "won"))
    return counts.withColumn("rank", rank).where("rank <= 3").drop("rank")


@query("SELECT s.ticker, round(h.low, 9) AS low, o.n FROM settled s JOIN (SELECT ticker, CAST(count(*) AS BIGINT) AS n FROM observations GROUP BY ticker) o ON s.ticker = o.ticker JOIN (SELECT DISTINCT ticker, min(hours) OVER (PARTITION BY ticker) AS low FROM observations) h ON s.ticker = h.ticker", "observations", "settled")
def w16_group_minimum(m):
    low = F.min("hours").over(Window.partitionBy("ticker"))
    return m.observations.select("ticker", low.alias("low")).groupBy("ticker").agg(F.round(F.max("low"), 9).alias("low"), F.count("*").alias("n"))


@query("SELECT trade_id, CAST(sum(count) OVER (PARTITION BY ticker) - sum(count) OVER (PARTITION BY ticker ORDER BY ts_us) AS BIGINT) AS still FROM tape", "tape")
def w09_remaining_flow(m):
    all_, upto = Window.partitionBy("ticker"), Window.partitionBy("ticker").orderBy("ts_us").rangeBetween(Window.unboundedPreceding, 0)
    return m.tape.select("trade_id", (F.sum("count").over(all_) - F.sum("count").over(upto)).alias("still"))


@query("SELECT event_ticker, ticker FROM settled QUALIFY row_number() OVER (PARTITION BY event_ticker ORDER BY o_totalprice DESC, ticker) = 1", "settled")
def w14_best_per_event(m):
    return J.first_of(m.settled, ["event_ticker"], F.col("o_totalprice").desc(), F.col("ticker")).select("event_ticker", "ticker")


@query("SELECT ticker, slice, CAST(count(*) AS BIGINT) AS n FROM (SELECT ticker, (SELECT CAST(count(*) AS INTEGER) FROM range(1, 4) g(i) WHERE round_even(i * (n / 3.0::DOUBLE), 0) <= rn) AS slice FROM (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY ts_us, trade_id) - 1 AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM tape)) GROUP BY ALL", "tape")
def w17_equal_slices(m):
    w = Window.partitionBy("ticker")
    rows = m.tape.select("ticker", (F.row_number().over(w.orderBy("ts_us", "trade_id")) - 1).alias("rn"), F.count("*").over(w).alias("n"))
    bounds = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.bround(i * (F.col("n") / F.lit(3.0))).cast("long"))
    return rows.select("ticker", F.size(F.filter(bounds, lambda b: b <= F.col("rn"))).alias("slice")).groupBy("ticker", "slice").agg(F.count("*").alias("n"))


@query("SELECT ticker, result, row_number() OVER (ORDER BY result DESC NULLS LAST, ticker) AS place FROM settled QUALIFY place <= 30", "settled")
def o02_nulls_last(m):
    top = m.settled.orderBy(F.col("result").desc_nulls_last(), "ticker").limit(30)
    return top.select("ticker", "result", F.row_number().over(Window.orderBy(F.col("result").desc_nulls_last(), "ticker")).cast("bigint").alias("place"))


@query("SELECT ticker FROM settled ORDER BY md5(ticker || '42'), ticker LIMIT 200", "settled")
def o05_seeded_sample(m):
    return m.settled.orderBy(F.md5(F.concat("ticker", F.lit("42")).cast("binary")), "ticker").limit(200).select("ticker")


@query("SELECT DISTINCT ticker FROM tape", "tape")
def u06_distinct_keys(m):
    return m.tape.select("ticker").distinct()


@query("SELECT event_ticker, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS shares FROM settled GROUP BY event_ticker", "settled")
def u05_set_intersection(m):
    kinds = m.settled.groupBy("event_ticker").agg(F.collect_set("o_orderpriority").alias("kinds"))
    return kinds.select("event_ticker", F.arrays_overlap("kinds", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("shares"))


@query("SELECT ticker, epoch_us(date_trunc('day', make_timestamp(ts_us))) AS day_us, epoch_us(date_trunc('week', make_timestamp(ts_us))) AS week_us, epoch_us(date_trunc('hour', make_timestamp(ts_us))) AS hour_us, CAST(hour(make_timestamp(ts_us)) AS INTEGER) AS hour, CAST(isodow(make_timestamp(ts_us)) - 1 AS INTEGER) AS weekday, trade_id FROM tape", "tape")
def x08_time_floors(m):
    at = F.timestamp_micros("ts_us")
    floor = lambda u: F.unix_micros(F.date_trunc(u, at)).alias(f"{u}_us")
    return m.tape.select("ticker", floor("day"), floor("week"), floor("hour"), F.hour(at).alias("hour"), F.weekday(at).alias("weekday"), "trade_id")


@query("SELECT trade_id, CASE taker_side WHEN 'yes' THEN 100 - yes_cents ELSE yes_cents END AS no_or_yes, CAST(round(100 * (0.9 - yes_cents / 100.0), 6) AS DOUBLE) AS edge FROM tape", "tape")
def x27_calibration_edge(m):
    edge = X.calibration_edge(F.lit("yes"), F.lit(0.9), F.col("yes_cents") / F.lit(100.0))
    return m.tape.select("trade_id", F.when(F.col("taker_side") == "yes", 100 - F.col("yes_cents")).otherwise(F.col("yes_cents")).alias("no_or_yes"), F.round(edge * 100, 6).alias("edge"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'other' END AS category FROM nation")
def x30_labels(m):
    label = F.coalesce(F.element_at(F.create_map(F.lit(0), F.lit("first"), F.lit(1), F.lit("second")), F.col("n_regionkey")), F.lit("other"))
    return m.raw("nation").select("n_nationkey", label.alias("category"))


@query("SELECT o_orderkey, lower(o_orderstatus) AS result, CASE WHEN o_totalprice > 200000 THEN o_totalprice ELSE o_custkey END AS volume FROM orders")
def p07_settled_markets(m):
    """The result in lower case, and the new volume unless it is zero."""
    rows = m.raw("orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).otherwise(0.0).alias("volume_fp"), F.col("o_custkey").cast("double").alias("volume"))
    return rows.select("o_orderkey", F.lower("o_orderstatus").alias("result"), F.coalesce(F.nullif("volume_fp", F.lit(0.0)), "volume").alias("volume"))


@query("SELECT event_ticker, max(settled_us) AS settled_us, CAST(count(*) AS BIGINT) AS num_markets FROM settled GROUP BY event_ticker", "settled")
def p08_settled_events(m):
    nested = m.settled.groupBy("event_ticker").agg(F.collect_list(F.struct("ticker", "settled_us")).alias("markets"))
    return nested.select("event_ticker", F.array_max("markets.settled_us").alias("settled_us"), F.size("markets").cast("bigint").alias("num_markets"))


@query("SELECT trade_id, CASE WHEN yes_cents + 2 > 0 THEN round(40000.0::DOUBLE / (2 * yes_cents + 2), 6) END AS bps FROM tape", "tape")
def p13_spreads(m):
    return m.tape.select("trade_id", F.round(P.spread_bps(F.col("yes_cents").cast("double"), F.col("yes_cents") + 2.0), 6).alias("bps"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'trash|clown|moron')")
def p18_keyword_exclusion(m):
    return m.raw("documents").where(F.lower("text").rlike("trash|clown|moron")).select("doc_id")


@query("SELECT l_orderkey AS k, l_linenumber AS l FROM lineitem WHERE l_returnflag <> 'N' EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N'")
def k04_insert_or_ignore(m):
    rows = m.raw("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("v"), "l_returnflag")
    return K.insert_new(rows.where("l_returnflag = 'N'"), rows.where("l_returnflag <> 'N'"), ["k", "l"]).select("k", "l")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '2' ELSE c_mktsegment END AS segment, c_nationkey AS nation FROM customer")
def k05_overwrite_upsert(m):
    old = m.raw("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    new = old.where("c_custkey % 2 = 0").select("c_custkey", F.concat("segment", F.lit("2")).alias("segment"), F.lit(-1).alias("nation"))
    return K.overwrite_upsert(old, new, ["c_custkey"], keep=["nation"])


@query(f"SELECT id, CAST(sum(CASE WHEN won THEN 100 - entry ELSE -entry END) OVER (ORDER BY id) AS BIGINT) AS running FROM ({TRADES})", "settled")
def k15_trade_export(m):
    return T.running_total(_trades(m), "id", "pnl", "running").select("id", F.col("running").cast("bigint").alias("running"))


@query("SELECT gp, topic, CAST(mid2 // 10 AS INTEGER) AS bucket, count(DISTINCT ticker) AS markets, CAST(count(*) AS BIGINT) AS n FROM observations GROUP BY ALL HAVING count(DISTINCT ticker) >= 20", "observations")
def a09_distinct_markets(m):
    rows = m.observations.select("gp", "topic", X.price_bucket(F.col("mid")).alias("bucket"), "ticker")
    return rows.groupBy("gp", "topic", "bucket").agg(F.count_distinct("ticker").alias("markets"), F.count("*").alias("n")).where("markets >= 20")


@query("SELECT ticker, source, CAST(count(*) AS BIGINT) AS n FROM (SELECT ticker, 'hourly' AS source FROM candles WHERE origin = 'R' UNION ALL SELECT ticker, 'snapshot' FROM candles WHERE origin = 'A' AND ticker NOT IN (SELECT ticker FROM candles WHERE origin = 'R') UNION ALL SELECT ticker, 'daily' FROM candles WHERE origin = 'N' AND ticker NOT IN (SELECT ticker FROM candles WHERE origin IN ('R', 'A'))) GROUP BY ALL", "candles")
def c02_three_sources(m):
    parts = [m.candles.where(F.col("origin") == o).select("ticker", F.lit(s).alias("source")) for o, s in (("R", "hourly"), ("A", "snapshot"), ("N", "daily"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return C.best_source(every, "ticker", "source", ["hourly", "snapshot", "daily"]).groupBy("ticker", "source").agg(F.count("*").alias("n"))


@query(f"SELECT series, CAST(least(0, min(cum)) AS BIGINT) AS lowest, CAST(min(cum) < -500 AS BOOLEAN) AS killed FROM (SELECT series, sum(CASE WHEN won THEN 100 - entry ELSE -entry END) OVER (PARTITION BY series ORDER BY id) AS cum FROM ({TRADES})) GROUP BY series", "settled")
def r05_loss_limit(m):
    rows = T.drawdown(_trades(m).withColumn("settled_us", F.col("id")), ["series"])
    return rows.groupBy("series").agg(F.least(F.lit(0), F.min("cum")).cast("bigint").alias("lowest"), (F.min("cum") < -500).alias("killed"))
