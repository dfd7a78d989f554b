"""Aggregations, windows, top-k and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import calibration as C
from tidemark.operators import joins as J
from tidemark.operators import track as T
from tidemark.plans.catalog import query


@query("SELECT gp, CAST(mid2 // 10 AS INTEGER) AS price_bucket, CAST(count(*) AS BIGINT) AS n, avg(mid2) AS avg_price, avg(CAST(yes AS INTEGER)) AS rate, avg(mid2) - avg(CAST(yes AS INTEGER)) AS gap FROM observations GROUP BY ALL", "observations")
def a01_bucket_stats(m):
    from tidemark.functions.exprs import price_bucket

    return C.bucket_stats(m.observations.withColumn("price_bucket", price_bucket(F.col("mid"))), ["gp", "price_bucket"], "mid2", "yes")


@query("SELECT gp, topic, CAST(mid2 // 10 AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(yes AS INTEGER)) AS BIGINT) AS n_yes, CAST(grouping_id(gp, topic, mid2 // 10) AS BIGINT) AS gid FROM observations GROUP BY GROUPING SETS ((gp), (topic), (gp, topic), (gp, mid2 // 10), (mid2 // 10), ())", "observations")
def a03_grouping_sets(m):
    rows = m.observations.select("gp", "topic", F.floor(F.col("mid2") / 10).cast("int").alias("bucket"), F.col("yes").cast("int").alias("y"))
    sets = [["gp"], ["topic"], ["gp", "topic"], ["gp", "bucket"], ["bucket"], []]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], "gp", "topic", "bucket").agg(F.count("*").alias("n"), F.sum("y").alias("n_yes"), F.grouping_id("gp", "topic", "bucket").alias("gid"))


@query("SELECT gp, CAST(count(*) AS BIGINT) AS n_markets, round(avg(m), 9) AS p, round(sqrt(avg(m) * (1 - avg(m)) / count(*)), 9) AS se FROM (SELECT gp, ticker, avg(CASE WHEN bid > 50 THEN 1 ELSE 0 END) AS m FROM observations GROUP BY gp, ticker) GROUP BY gp", "observations")
def a05_mean_of_market_means(m):
    from tidemark.functions.exprs import binomial_se

    each = m.observations.groupBy("gp", "ticker").agg(F.avg((F.col("bid") > 50).cast("int")).alias("m"))
    out = each.groupBy("gp").agg(F.count("*").alias("n_markets"), F.avg("m").alias("p"))
    return out.select("gp", "n_markets", F.round("p", 9).alias("p"), F.round(binomial_se(F.col("p"), F.col("n_markets")), 9).alias("se"))


@query("SELECT series, origin FROM (SELECT series, origin, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, min(period_us), origin) AS rn FROM observations GROUP BY series, origin) WHERE rn = 1", "observations")
def a07_first_seen_mode(m):
    votes = m.observations.groupBy("series", "origin").agg(F.count("*").alias("n"), F.min("period_us").alias("first"))
    return J.first_of(votes, ["series"], F.col("n").desc(), F.col("first"), F.col("origin")).select("series", "origin")


@query("SELECT series, CAST(count(*) FILTER (WHERE result = 'yes') AS BIGINT) AS won, CAST(count(*) FILTER (WHERE result IS NULL) AS BIGINT) AS open_, count(DISTINCT event_ticker) AS events FROM settled GROUP BY series HAVING count(*) >= 10 ORDER BY count(*) DESC", "settled")
def a08_filtered_counts(m):
    return m.settled.groupBy("series").agg(F.count_if(F.col("result") == "yes").alias("won"), F.count_if(F.col("result").isNull()).alias("open_"), F.count_distinct("event_ticker").alias("events"), F.count("*").alias("n")).where("n >= 10").orderBy(F.col("n").desc()).drop("n")


@query("SELECT series, count(DISTINCT event_ticker) AS events, CAST(count(ticker) AS BIGINT) AS markets, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)), 0) AS BIGINT) AS volume FROM settled GROUP BY series", "settled")
def a11_series_summary(m):
    return m.settled.groupBy("series").agg(F.count_distinct("event_ticker").alias("events"), F.count("ticker").alias("markets"), F.coalesce(F.sum(F.floor("o_totalprice")), F.lit(0)).alias("volume"))


@query("SELECT series, avg(n) AS avg_markets, CAST(max(n) AS BIGINT) AS most FROM (SELECT series, event_ticker, count(*) AS n FROM settled GROUP BY ALL) GROUP BY series", "settled")
def a12_markets_per_event(m):
    return m.settled.groupBy("series", "event_ticker").agg(F.count("*").alias("n")).groupBy("series").agg(F.avg("n").alias("avg_markets"), F.max("n").alias("most"))


@query("SELECT p_brand, CAST(count(*) FILTER (WHERE p_size % 2 = 0) AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE p_size % 2 = 1) AS BIGINT) AS puts, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY p_brand")
def a14_expiry_summary(m):
    call = F.col("p_size") % 2 == 0
    return m.raw("part").groupBy("p_brand").agg(F.count_if(call).alias("calls"), F.count_if(~call).alias("puts"), F.min("p_size").alias("low"), F.max("p_size").alias("high"))


@query("SELECT s.s_suppkey, CAST(count(l_orderkey) AS BIGINT) AS n, epoch_us(min(l_shipdate)) AS first_us, epoch_us(max(l_shipdate)) AS last_us FROM supplier s LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 49 GROUP BY s.s_suppkey")
def a15_observation_ranges(m):
    rows = m.raw("lineitem").where("l_quantity > 49").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return m.raw("supplier").join(rows, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"), us("a").alias("first_us"), us("b").alias("last_us"))


TRADES = "SELECT o_orderkey AS id, series, CASE WHEN result = 'yes' THEN 100 - (85 + o_orderkey % 13) ELSE -(85 + o_orderkey % 13) END * (1 + o_orderkey % 5) - 1 AS pnl, (85 + o_orderkey % 13) AS entry, 1 + o_orderkey % 5 AS contracts, settled_us, result = 'yes' AS won FROM settled WHERE result IS NOT NULL"


def _trades(m):
    entry, contracts = 85 + F.col("o_orderkey") % 13, 1 + F.col("o_orderkey") % 5
    from tidemark.functions.exprs import pnl

    out = F.when(F.col("result") == "yes", 100).otherwise(0)
    return m.settled.where("result IS NOT NULL").select(F.col("o_orderkey").alias("id"), "series", pnl(entry, out, contracts, F.lit(1)).alias("pnl"), entry.alias("entry"), contracts.alias("contracts"), "settled_us", (F.col("result") == "yes").alias("won"))


@query(f"SELECT series, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(pnl) AS BIGINT) AS total, round(avg(pnl), 6) AS mean, round(coalesce(stddev_samp(pnl), 0), 6) AS std, round(CASE WHEN coalesce(stddev_samp(pnl), 0) = 0 THEN 0 ELSE avg(pnl) / stddev_samp(pnl) END, 6) AS sharpe FROM ({TRADES}) GROUP BY series", "settled")
def a20_track_summary(m):
    return T.summary(_trades(m), ["series"])


@query(f"SELECT id, CAST(sum(pnl) OVER w AS BIGINT) AS cum, CAST(greatest(0, max(cum) OVER w) AS BIGINT) AS peak, CAST(greatest(0, max(cum) OVER w) - cum AS BIGINT) AS drawdown FROM (SELECT *, sum(pnl) OVER (PARTITION BY series ORDER BY settled_us, id) AS cum FROM ({TRADES})) WINDOW w AS (PARTITION BY series ORDER BY settled_us, id)", "settled")
def w11_drawdown(m):
    return T.drawdown(_trades(m), ["series"]).select("id", "cum", "peak", "drawdown")


@query(f"SELECT id, CASE WHEN n = 50 THEN wins < 25 ELSE false END AS paused FROM (SELECT id, count(*) OVER w AS n, sum(CAST(won AS INTEGER)) OVER w AS wins FROM ({TRADES}) WINDOW w AS (PARTITION BY series ORDER BY settled_us, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))", "settled")
def w12_rolling_window(m):
    last = Window.partitionBy("series").orderBy("settled_us", "id").rowsBetween(-49, 0)
    rows = _trades(m).select("id", F.count("*").over(last).alias("n"), F.sum(F.col("won").cast("int")).over(last).alias("wins"))
    return rows.select("id", ((F.col("n") == 50) & (F.col("wins") < 25)).alias("paused"))


@query(f"SELECT series, coalesce(CAST(won AS VARCHAR), 'all') AS outcome, CAST(count(*) AS BIGINT) AS n, CAST(sum(contracts) AS BIGINT) AS contracts FROM ({TRADES}) GROUP BY GROUPING SETS ((series, won), (series))", "settled")
def a23_decomposition(m):
    rows = _trades(m).withColumn("won", F.col("won").cast("string"))
    out = rows.groupingSets([[F.col("series"), F.col("won")], [F.col("series")]], "series", "won").agg(F.count("*").alias("n"), F.sum("contracts").cast("bigint").alias("contracts"))
    return out.select("series", F.coalesce("won", F.lit("all")).alias("outcome"), "n", "contracts")


@query(f"SELECT CAST(floor(entry / 10) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(pnl) / (stddev_pop(pnl) / sqrt(count(*))), 6) AS t FROM ({TRADES}) GROUP BY 1 HAVING count(*) >= 5", "settled")
def a27_bins_with_t(m):
    out = _trades(m).groupBy(F.floor(F.col("entry") / 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("pnl").alias("a"), F.stddev_pop("pnl").alias("s")).where("n >= 5")
    return out.select("bin", "n", F.round(F.col("a") / (F.col("s") / F.sqrt("n")), 6).alias("t"))


@query("SELECT 'U' || user_id AS ticker, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS view FROM events GROUP BY user_id")
def a30_matrix(m):
    return m.tape.groupBy("ticker").pivot("event_type", ["error", "view"]).agg(F.count(F.lit(1))).select("ticker", F.coalesce("error", F.lit(0)).alias("error"), F.coalesce("view", F.lit(0)).alias("view"))


@query("SELECT ticker, period_us, seq, bid FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_us DESC, seq DESC) AS rn FROM candles) WHERE rn = 1", "candles")
def w01_top_one(m):
    return J.first_of(m.candles, ["ticker"], F.col("period_us").desc(), F.col("seq").desc()).select("ticker", "period_us", "seq", "bid")


@query("SELECT series, CAST(bucket AS INTEGER) AS bucket, round(sum(v * w) OVER s / sum(w) OVER s, 9) AS smooth FROM (SELECT series, mid2 // 10 AS bucket, avg(CAST(yes AS INTEGER)) AS v, count(*) AS w FROM observations GROUP BY ALL) WINDOW s AS (PARTITION BY series ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "observations")
def w03_smoothing(m):
    cells = m.observations.groupBy("series", F.floor(F.col("mid2") / 10).cast("int").alias("bucket")).agg(F.avg(F.col("yes").cast("int")).alias("v"), F.count("*").alias("w"))
    return C.smoothed(cells, ["series"], "bucket", "v", "w").select("series", "bucket", F.round("smooth", 9).alias("smooth"))


@query("SELECT trade_id, CAST(coalesce(sum(count) OVER (PARTITION BY ticker ORDER BY ts_us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(count) OVER (PARTITION BY ticker ORDER BY ts_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM tape", "tape")
def w05_trailing_windows(m):
    day = Window.partitionBy("ticker").orderBy("ts_us")
    return m.tape.select("trade_id", F.coalesce(F.sum("count").over(day.rangeBetween(-86_400_000_000, -1)), F.lit(0)).alias("before"), F.sum("count").over(day.rangeBetween(-86_400_000_000, 0)).alias("upto"))


@query("SELECT trade_id, CAST(sum(count) OVER w AS BIGINT) AS so_far, CAST(sum(count) OVER (PARTITION BY ticker) - sum(count) OVER w AS BIGINT) AS still FROM tape WINDOW w AS (PARTITION BY ticker ORDER BY ts_us, trade_id ROWS UNBOUNDED PRECEDING)", "tape")
def w08_prefix_and_suffix(m):
    w = Window.partitionBy("ticker")
    run = w.orderBy("ts_us", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    return m.tape.select("trade_id", F.sum("count").over(run).alias("so_far"), (F.sum("count").over(w) - F.sum("count").over(run)).alias("still"))


@query("SELECT ticker, period_us, seq, min(ask) OVER w AS low, max(bid) OVER w AS high FROM candles WINDOW w AS (PARTITION BY ticker ORDER BY period_us, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)", "candles")
def w10_suffix_extremes(m):
    later = Window.partitionBy("ticker").orderBy("period_us", "seq").rowsBetween(1, Window.unboundedFollowing)
    return m.candles.select("ticker", "period_us", "seq", F.min("ask").over(later).alias("low"), F.max("bid").over(later).alias("high"))


@query("SELECT event_ticker, ticker, CAST(dense_rank() OVER (ORDER BY top DESC, event_ticker) AS INTEGER) AS event_rank FROM (SELECT event_ticker, ticker, max(o_orderkey) OVER (PARTITION BY event_ticker) AS top FROM settled) QUALIFY event_rank <= 20", "settled")
def w13_best_events(m):
    best = m.settled.groupBy("event_ticker").agg(F.max("o_orderkey").alias("top")).orderBy(F.col("top").desc(), "event_ticker").limit(20)
    ranked = best.withColumn("event_rank", F.row_number().over(Window.orderBy(F.col("top").desc(), "event_ticker")))
    return m.settled.join(F.broadcast(ranked), "event_ticker").select("event_ticker", "ticker", "event_rank")


@query("SELECT ticker, period_us, seq, origin FROM (SELECT *, min(CASE origin WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) OVER (PARTITION BY ticker) AS best FROM observations) WHERE best = CASE origin WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END", "observations")
def w15_best_source(m):
    return C.best_source(m.observations, "ticker", "origin", ["R", "A", "N"]).select("ticker", "period_us", "seq", "origin")


@query("SELECT trade_id, (ts_us - max(CASE WHEN taker_side = 'no' AND yes_cents <= 90 THEN ts_us END) OVER (PARTITION BY ticker ORDER BY ts_us, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6 AS since_s FROM tape", "tape")
def w18_time_since(m):
    before = Window.partitionBy("ticker").orderBy("ts_us", "trade_id").rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when((F.col("taker_side") == "no") & (F.col("yes_cents") <= 90), F.col("ts_us"))
    return m.tape.select("trade_id", ((F.col("ts_us") - F.last(hit, ignorenulls=True).over(before)) / F.lit(1e6)).alias("since_s"))


@query("SELECT ticker, o_totalprice FROM settled ORDER BY o_totalprice DESC, ticker LIMIT 25", "settled")
def o01_latest(m):
    return m.settled.orderBy(F.col("o_totalprice").desc(), "ticker").limit(25).select("ticker", "o_totalprice")


@query("SELECT result, ticker FROM (SELECT result, ticker, row_number() OVER (PARTITION BY result ORDER BY md5(ticker || '42'), ticker) AS rn FROM settled WHERE result IS NOT NULL) WHERE rn <= 100", "settled")
def o04_seeded_sample_by_class(m):
    order = F.md5(F.concat("ticker", F.lit("42")).cast("binary"))
    rows = m.settled.where("result IS NOT NULL").select("result", "ticker", F.row_number().over(Window.partitionBy("result").orderBy(order, "ticker")).alias("rn"))
    return rows.where("rn <= 100").drop("rn")


@query(
    """SELECT ticker, period_us, (bid + ask) / 200.0 AS price, 'hourly' AS kind FROM candles WHERE origin = 'R' UNION ALL SELECT ticker, period_us, (bid + ask) / 200.0, 'daily' FROM candles WHERE origin = 'A'
    UNION ALL SELECT ticker, period_us, bid / 100.0, 'archive' FROM candles WHERE origin = 'N' UNION ALL SELECT ticker, ts_us, yes_cents / 100.0, 'snapshot' FROM tape""",
    "candles",
    "tape",
)
def u01_union_all(m):
    """The four price sources, each with its own price: two kinds of candles by their middle, the archive by its bid, snapshots."""
    quotes = {kind: m.candles.where(F.col("origin") == origin) for kind, origin in (("hourly", "R"), ("daily", "A"), ("archive", "N"))}
    middle, bid = (F.col("bid") + F.col("ask")) / F.lit(200.0), F.col("bid") / F.lit(100.0)
    parts = [df.select("ticker", "period_us", (bid if kind == "archive" else middle).alias("price"), F.lit(kind).alias("kind")) for kind, df in quotes.items()]
    out = m.tape.select("ticker", F.col("ts_us").alias("period_us"), (F.col("yes_cents") / F.lit(100.0)).alias("price"), F.lit("snapshot").alias("kind"))
    for part in parts:
        out = out.unionByName(part)
    return out


@query("SELECT series, o_orderpriority FROM settled WHERE result = 'yes' UNION SELECT series, o_orderpriority FROM settled WHERE result = 'no'", "settled")
def u02_union_distinct(m):
    pick = lambda r: m.settled.where(F.col("result") == r).select("series", "o_orderpriority")
    return pick("yes").union(pick("no")).distinct()


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u04_difference(m):
    o = m.raw("orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))
