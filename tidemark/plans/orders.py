"""Virtual orders, backtests and pairs."""

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import strategy as S
from tidemark.operators import virtual as V
from tidemark.plans.catalog import query
from tidemark.plans.scalars import FEE
from tidemark.session import dealt


@query(
    """SELECT ticker, fraction, period_us, bid FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period_us ORDER BY fraction) AS d FROM (SELECT p.ticker, p.fraction, c.period_us, c.bid, row_number() OVER (PARTITION BY p.ticker, p.fraction ORDER BY c.period_us DESC, c.seq DESC) AS rn FROM
    (SELECT ticker, f AS fraction, a + CAST(floor((b - a) * f) AS BIGINT) AS at_us FROM (SELECT ticker, min(period_us) AS a, max(period_us) AS b FROM candles GROUP BY ticker), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(f)) p JOIN candles c ON p.ticker = c.ticker AND c.period_us <= p.at_us) WHERE rn = 1) WHERE d = 1""",
    "candles",
)
def j20_lifecycle_quotes(m):
    markets = m.candles.groupBy("ticker").agg(F.min("period_us").alias("first_us"), F.max("period_us").alias("close_us"))
    return V.lifecycle_quotes(markets, m.candles, (0.25, 0.5, 0.75), ["bid"]).select("ticker", "fraction", F.col("matched_at").alias("period_us"), "bid")


@query("SELECT o.trade_id AS order_id, CAST(coalesce(sum(t.count) FILTER (WHERE t.ts_us >= o.ts_us - 1800000000), 0) AS BIGINT) AS volume_30m, CAST(coalesce(sum(t.count), 0) AS BIGINT) AS volume_2h FROM tape o LEFT JOIN tape t ON o.ticker = t.ticker AND t.ts_us < o.ts_us AND t.ts_us >= o.ts_us - 7200000000 GROUP BY ALL", "tape")
def w07_recent_volumes(m):
    orders = m.tape.select(F.col("trade_id").alias("order_id"), "ticker", F.col("ts_us").alias("placed_us"))
    return V.recent_volume(m.tape, orders).select("order_id", "volume_30m", "volume_2h")


@query(
    """SELECT ticker, side, CAST(entry AS INTEGER) AS entry, won, CAST(CASE WHEN won THEN 100 - entry ELSE -entry END - 1 AS INTEGER) AS pnl FROM (SELECT *, result = side AS won, row_number() OVER (PARTITION BY ticker ORDER BY period_us, seq) AS rn FROM (
    SELECT c.ticker, period_us, seq, result, CASE WHEN (bid + ask) // 2 >= 85 THEN 'yes' ELSE 'no' END AS side, CASE WHEN (bid + ask) // 2 >= 85 THEN (bid + ask) // 2 ELSE CAST(floor((200 - bid - ask) / 2.0) AS INTEGER) END AS entry
    FROM candles c JOIN settled s ON c.ticker = s.ticker WHERE result IS NOT NULL AND period_us < settled_us AND bid > 0 AND ask > 0 AND ask - bid BETWEEN 0 AND 10) WHERE entry BETWEEN 85 AND 97) WHERE rn = 1""",
    "candles",
)
def m10_first_tail_backtest(m):
    return V.first_tail_backtest(m.candles, m.settled.select("ticker", "result", "settled_us"))


@query("SELECT seq, side, CAST(lim AS INTEGER) AS lim, CAST(count(*) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS contracts FROM (SELECT seq, 'yes' AS side, bid + o AS lim FROM candles, range(-4, 5) r(o) UNION ALL SELECT seq, 'no', 100 - ask + o FROM candles, range(-4, 5) r(o)), (VALUES (1), (5), (10), (20), (50)) v(q) WHERE lim BETWEEN 1 AND 99 GROUP BY ALL", "candles")
def m07_training_grid(m):
    """Quotes are dealt out by seq before they become a grid, which then needs no shuffle."""
    grid = V.training_grid(dealt(m.candles.select("seq", "bid", "ask"), m.raw("lineitem").count(), "seq"))
    return grid.groupBy("seq", "side", F.col("limit").alias("lim")).agg(F.count("*").alias("n"), F.sum("quantity").alias("contracts"))


@query(
    """WITH q AS (SELECT ticker, period_us, seq, l.lim, 20 + seq % 30 AS quantity, period_us + 7776000000000 AS end_us, s.side FROM candles, (VALUES (40), (60)) l(lim), (VALUES ('yes'), ('no')) s(side)),
    f AS (SELECT q.*, c.period_us AS at_us, sum(CASE WHEN c.volume > 0 THEN least(greatest(CAST(floor(c.volume * 0.5) AS INTEGER), 1), quantity) ELSE 0 END) OVER (PARTITION BY q.seq, q.ticker, q.period_us, q.lim, q.side ORDER BY c.period_us, c.seq) AS upto
      FROM q JOIN candles c ON q.ticker = c.ticker AND c.period_us > q.period_us AND c.period_us < q.end_us AND CASE side WHEN 'yes' THEN c.ask <= lim OR c.volume <= lim AND c.volume > 0 ELSE 100 - c.bid <= lim OR c.volume > 0 AND 100 - c.volume <= lim END)
    SELECT q.ticker, q.seq, q.side, q.lim, CAST(least(any_value(q.quantity), coalesce(max(upto), 0)) AS BIGINT) AS filled, round(least(any_value(q.quantity), coalesce(max(upto), 0)) / any_value(q.quantity)::DOUBLE, 9) AS share, min(at_us) FILTER (WHERE upto > 0) AS first_us
    FROM q LEFT JOIN f ON q.ticker = f.ticker AND q.seq = f.seq AND q.period_us = f.period_us AND q.lim = f.lim AND q.side = f.side GROUP BY q.ticker, q.seq, q.period_us, q.side, q.lim""",
    "candles",
)
def m03_candle_fills(m):
    """Orders on both sides at two limits with every candle, each until ninety days later. Candles are dealt out by market once joined, so that the rows made of them stay in their tasks."""
    rows = dealt(m.candles.drop("origin"), m.raw("lineitem").count(), "ticker", rows_a_task=50_000)
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(p).alias("limit")) for s in ("yes", "no") for p in (40, 60)]))
    placed = rows.select("ticker", F.col("period_us").alias("placed_us"), "seq", grid.alias("g")).select("*", "g.*").drop("g")
    orders = placed.select("ticker", "side", "limit", "placed_us", F.struct("ticker", "seq", "side", F.col("limit").alias("lim")).alias("order_id"), (20 + F.col("seq") % 30).alias("quantity"), (F.col("placed_us") + 90 * 86_400_000_000).alias("end_us"))
    candles = rows.select("ticker", "period_us", "seq", "volume", F.col("bid").alias("bid_high"), F.col("ask").alias("ask_low"), F.col("volume").alias("price_high"), F.col("volume").alias("price_low"))
    return V.candle_fill_totals(orders, candles, 0.5).select("order_id.*", "filled", F.round("share", 9).alias("share"), "first_us")


@query(
    """SELECT ticker, period_us, side, CAST(sum(flow) AS BIGINT) AS flow, CAST(sum(CASE WHEN flow >= 0.3 * 10 + 5 THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM (SELECT g.ticker, g.period_us, g.side, g.step, coalesce(sum(CASE WHEN side = 'yes' AND taker_side = 'no' AND yes_cents <= lim OR side = 'no' AND taker_side = 'yes' AND yes_cents >= 100 - lim THEN t.count END), 0) AS flow
    FROM (SELECT q.*, s.side, r.step, greatest(1, least(99, CASE WHEN s.side = 'yes' THEN 86 ELSE 4 END + CAST(round_even(r.step / 10.0::DOUBLE * 10, 0) AS INTEGER))) AS lim FROM (SELECT ticker, ts_us AS period_us, trade_id AS seq FROM tape) q, (VALUES ('yes'), ('no')) s(side), range(0, 11) r(step)) g
    JOIN tape_markets k ON g.ticker = k.ticker LEFT JOIN tape t ON g.ticker = t.ticker AND t.ts_us > g.period_us AND t.ts_us < k.settled_us GROUP BY ALL) GROUP BY ALL""",
    "tape_markets",
)
def c09_training_rows(m):
    quotes = m.tape.select("ticker", F.col("ts_us").alias("period_us"), F.col("trade_id").alias("seq"), F.lit(86).alias("bid"), F.lit(96).alias("ask"), F.lit(10).alias("open_interest")).join(m.tape_markets.select("ticker", "settled_us"), "ticker")
    rows = V.gbt_training_rows(quotes, m.tape, (5,))
    return rows.groupBy("ticker", "period_us", "side").agg(F.sum("flow").cast("bigint").alias("flow"), F.count_if("filled_5").alias("filled"))


@query(
    f"""WITH t AS (SELECT DISTINCT event_ticker, ticker, CAST(split_part(ticker, '-', 3) AS DOUBLE) AS strike, side, mid FROM (
      SELECT *, 'yes' AS side, mid2 // 2 AS mid FROM (SELECT * EXCLUDE (mid) FROM observations) UNION ALL SELECT *, 'no', CAST(floor((200 - mid2) / 2.0) AS INTEGER) FROM (SELECT * EXCLUDE (mid) FROM observations)) WHERE ask - bid BETWEEN 0 AND 10 AND mid BETWEEN 85 AND 97),
    n AS (SELECT *, 0.05::DOUBLE - {FEE.format(c="mid", q=1)} / 100.0 AS net FROM t), g AS (SELECT * FROM n WHERE net >= 0.01),
    p AS (SELECT y.event_ticker, y.ticker AS y_ticker, n.ticker AS n_ticker, y.net + n.net AS total FROM g y JOIN g n ON y.event_ticker = n.event_ticker AND y.side = 'yes' AND n.side = 'no' AND y.strike < n.strike)
    SELECT event_ticker, y_ticker, n_ticker, round(total / 2, 6) AS mean_net FROM p QUALIFY row_number() OVER (PARTITION BY event_ticker ORDER BY total DESC, y_ticker, n_ticker) = 1""",
    "observations",
)
def r03_tail_pairs(m):
    tails = m.observations.select("event_ticker", "ticker", "gp", "topic", F.explode(X.tails(F.col("bid"), F.col("ask"))).alias("t")).select("event_ticker", "ticker", "gp", "topic", "t.side", "t.mid", X.strike_of(F.col("ticker")).alias("strike")).distinct()
    edges = m.classes.select("gp", "topic").distinct().withColumn("edge", F.lit(0.05))
    return S.tail_pairs(tails, edges, 0.01).select("event_ticker", "y_ticker", "n_ticker", F.round("mean_net", 6).alias("mean_net"))


@query("SELECT user_id, arg_min(value, (abs(epoch_us(ts) - 1705000000000000), event_id)) AS value FROM events WHERE value BETWEEN 0.01 AND 99 GROUP BY user_id")
def q45_nearest_to_horizon(m):
    e = m.raw("events").where("value BETWEEN 0.01 AND 99")
    gap = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - 1705000000000000)
    return e.groupBy("user_id").agg(F.min_by("value", F.struct(gap, "event_id")).alias("value"))


@query("SELECT event_ticker, arg_max(ticker, (o_totalprice, ticker)) AS winner FROM settled GROUP BY event_ticker HAVING count(*) = 2", "settled")
def q46_winner_of_two(m):
    return m.settled.groupBy("event_ticker").agg(F.count("*").alias("n"), F.max_by("ticker", F.struct("o_totalprice", "ticker")).alias("winner")).where("n = 2").select("event_ticker", "winner")


@query("SELECT ticker, event_ticker, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN series ELSE '' END, ''), split_part(ticker, '-', 1)) AS series, coalesce(result, 'none') AS result FROM settled", "settled")
def q35_trade_records(m):
    given = F.when(F.col("o_orderkey") % 2 == 0, F.col("series")).otherwise("")
    return m.settled.select("ticker", "event_ticker", F.coalesce(F.nullif(given, F.lit("")), X.series(F.col("ticker"))).alias("series"), F.coalesce("result", F.lit("none")).alias("result"))
