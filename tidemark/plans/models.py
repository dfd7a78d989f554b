"""Calibration, fills, flow, simulation and strategy."""

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import calibration as C
from tidemark.operators import flow as W
from tidemark.operators import strategy as S
from tidemark.plans.catalog import query
from tidemark.plans.scalars import FEE
from tidemark.session import dealt, written

RATES_SQL = """WITH o AS (SELECT *, CAST(mid2 // 10 AS INTEGER) AS price_bucket FROM observations),
cell AS (SELECT gp, topic, price_bucket, count(DISTINCT ticker) AS m, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT ticker) >= 50),
k AS (SELECT *, greatest(1, least(m // 30, 20)) AS k FROM cell),
r AS (SELECT o.*, k.k, k.n, row_number() OVER (PARTITION BY o.gp, o.topic, o.price_bucket ORDER BY o.hours, o.ticker, o.period_us, o.seq) - 1 AS rn FROM o JOIN k ON o.gp = k.gp AND o.topic = k.topic AND o.price_bucket = k.price_bucket),
b AS (SELECT *, CAST((SELECT count(*) FROM range(1, 21) g(i) WHERE i <= k AND round_even(i * (n / CAST(k AS DOUBLE)), 0) <= rn) AS INTEGER) AS bucket_index FROM r),
mk AS (SELECT gp, topic, price_bucket, bucket_index, ticker, avg(CAST(yes AS INTEGER)) AS mm, count(*) AS c, min(hours) AS h0, max(hours) AS h1 FROM b GROUP BY ALL),
s AS (SELECT gp, topic, price_bucket, bucket_index, min(h0) AS hours_from, max(h1) AS hours_to, CAST(sum(c) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_markets, avg(mm) AS p_raw FROM mk GROUP BY ALL),
v AS (SELECT gp, topic, price_bucket, bucket_index, origin AS source, row_number() OVER (PARTITION BY gp, topic, price_bucket, bucket_index ORDER BY count(*) DESC, min(rn)) AS q FROM b GROUP BY gp, topic, price_bucket, bucket_index, origin)
SELECT s.gp, s.topic, s.price_bucket, s.bucket_index, hours_from, hours_to, s.n, n_markets, source, round(p_raw, 9) AS p_raw, round(sqrt(p_raw * (1 - p_raw) / n_markets), 9) AS se,
round(sum(p_raw * n_markets) OVER w / sum(n_markets) OVER w, 9) AS p_yes FROM s JOIN v ON s.gp = v.gp AND s.topic = v.topic AND s.price_bucket = v.price_bucket AND s.bucket_index = v.bucket_index AND q = 1
WINDOW w AS (PARTITION BY s.gp, s.topic, s.price_bucket ORDER BY s.bucket_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""


def _rates(m, least=C.LEAST_MARKETS):
    return C.event_rates(m.observations.withColumn("source", F.col("origin")), "mid", least, ("R", "A", "N"))


@query(RATES_SQL, "observations")
def c01_event_rates(m):
    out = _rates(m)
    return out.select("gp", "topic", "price_bucket", "bucket_index", "hours_from", "hours_to", "n", "n_markets", "source", *[F.round(c, 9).alias(c) for c in ("p_raw", "se", "p_yes")])


@query("SELECT method, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents2) AS BIGINT) AS cents2 FROM (SELECT 'bid' AS method, 2 * bid AS cents2 FROM candles UNION ALL SELECT 'mid', bid + ask FROM candles UNION ALL SELECT 'ask', 2 * ask FROM candles UNION ALL SELECT 'trade', 2 * (bid + seq % (ask - bid + 1)) FROM candles WHERE seq % 3 > 0 AND bid + seq % (ask - bid + 1) > 0) GROUP BY method", "candles")
def c03_price_methods(m):
    """A trade between bid and ask, or none, beside the quote."""
    trade = F.when(F.col("seq") % 3 > 0, F.col("bid") + F.col("seq") % (F.col("ask") - F.col("bid") + 1)).otherwise(0)
    prices = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), C.conditioning_price(k, F.col("bid"), F.col("ask"), trade).alias("price")) for k in C.METHODS]))
    rows = m.candles.select(prices.alias("p")).select("p.*").where("price IS NOT NULL")
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.sum(F.round(F.col("price") * 200).cast("bigint")).alias("cents2"))


@query("SELECT series, CAST(count(*) AS BIGINT) AS n, avg(CAST(won AS INTEGER)) * 100 AS win_pct, avg(mid2) AS implied_pct, avg(CAST(won AS INTEGER)) * 100 - avg(mid2) AS edge FROM (SELECT series, CASE WHEN mid2 >= 170 THEN mid2 ELSE 200 - mid2 END AS mid2, CASE WHEN mid2 >= 170 THEN yes ELSE NOT yes END AS won FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_us DESC, seq DESC) AS rn FROM observations) WHERE rn = 1 AND (mid2 >= 170 OR mid2 <= 30)) GROUP BY series HAVING count(*) >= 3", "observations")
def c04_series_edges(m):
    from tidemark.operators.joins import first_of

    last = first_of(m.observations, ["ticker"], F.col("period_us").desc(), F.col("seq").desc()).where("mid2 >= 170 OR mid2 <= 30")
    high = F.col("mid2") >= 170
    rows = last.select("series", F.when(high, F.col("mid2")).otherwise(200 - F.col("mid2")).alias("mid"), F.when(high, F.col("yes")).otherwise(~F.col("yes")).alias("won"))
    return C.series_edges(rows, 3)


@query("SELECT horizon, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN (mid2 >= 170) = yes THEN 1 ELSE 0 END) AS BIGINT) AS won FROM (SELECT *, CASE WHEN hours < 24 THEN 1 WHEN hours < 168 THEN 2 WHEN hours < 720 THEN 3 WHEN hours < 8760 THEN 4 ELSE 5 END AS horizon FROM observations WHERE mid2 BETWEEN 170 AND 194 OR mid2 BETWEEN 6 AND 30) GROUP BY horizon", "observations")
def c06_edge_by_horizon(m):
    h = F.col("hours")
    horizon = F.when(h < 24, 1).when(h < 168, 2).when(h < 720, 3).when(h < 8760, 4).otherwise(5)
    rows = m.observations.select(horizon.alias("horizon"), X.favorite_won(F.col("mid"), F.col("yes")).alias("won")).where("won IS NOT NULL")
    return rows.groupBy("horizon").agg(F.count("*").alias("n"), F.count_if("won").alias("won"))


FILLS_SQL = """WITH q AS (SELECT o.ticker, o.gp, o.topic, o.result, o.hours, o.bid, o.ask, count(*) OVER w AS later, min(CASE WHEN ask > 0 THEN ask END) OVER w AS low, max(CASE WHEN bid > 0 THEN bid END) OVER w AS high FROM observations o WINDOW w AS (PARTITION BY ticker ORDER BY period_us, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, 'yes' AS side, bid AS b, ask AS a, low AS reach FROM q WHERE later > 0 UNION ALL SELECT *, 'no', 100 - ask, 100 - bid, 100 - high FROM q WHERE later > 0),
g AS (SELECT s.*, step, greatest(b, least(a, b + CAST(round_even((step / 10.0::DOUBLE) * (a - b), 0) AS INTEGER))) AS lim FROM s, range(0, 11) r(step) WHERE a > b),
c AS (SELECT gp, topic, CASE WHEN hours < 1 THEN '<1h' WHEN hours < 3 THEN '<3h' WHEN hours < 6 THEN '<6h' WHEN hours < 12 THEN '<12h' WHEN hours < 24 THEN '<24h' WHEN hours < 72 THEN '<72h' WHEN hours < 168 THEN '<168h' ELSE '>168h' END AS time_bucket, side, CAST(step AS INTEGER) AS step, CAST(count(*) FILTER (WHERE result = side) AS BIGINT) AS n_won, CAST(count(*) FILTER (WHERE result <> side) AS BIGINT) AS n_lost, CAST(count(*) FILTER (WHERE result = side AND reach <= lim) AS BIGINT) AS filled_won, CAST(count(*) FILTER (WHERE result <> side AND reach <= lim) AS BIGINT) AS filled_lost FROM g GROUP BY ALL)
SELECT *, CASE WHEN n_won > 0 THEN filled_won / CAST(n_won AS DOUBLE) ELSE 0 END AS rate_won, CASE WHEN n_lost > 0 THEN filled_lost / CAST(n_lost AS DOUBLE) ELSE 0 END AS rate_lost,
CASE WHEN n_lost > 0 THEN filled_lost / CAST(n_lost AS DOUBLE) ELSE 0 END - CASE WHEN n_won > 0 THEN filled_won / CAST(n_won AS DOUBLE) ELSE 0 END AS adverse FROM c WHERE n_won + n_lost >= 30"""


def _fill_rates(m):
    rows = m.observations.withColumn("ask_low", F.col("ask")).withColumn("bid_high", F.col("bid"))
    return C.fill_rates(rows, rows)


@query(FILLS_SQL, "observations")
def c07_fill_rates(m):
    return _fill_rates(m)


FLOW_SQL = """WITH f AS (SELECT ticker, min(ts_us) AS first_us FROM tape GROUP BY ticker),
p AS (SELECT k.*, first_us + 3600000000 * g.i AS at_us FROM tape_markets k JOIN f ON k.ticker = f.ticker, range(0, 1000) g(i) WHERE first_us + 3600000000 * g.i < settled_us),
v AS (SELECT p.ticker, p.at_us, p.gp, p.topic, p.result, (p.settled_us - p.at_us) / 3.6e9 AS hours, coalesce(sum(t.count) FILTER (WHERE t.ts_us >= p.at_us - 86400000000 AND t.ts_us < p.at_us), 0) AS volume, {sums} FROM p LEFT JOIN tape t ON p.ticker = t.ticker AND t.ts_us < p.settled_us GROUP BY ALL),
o AS (SELECT gp, topic, CASE WHEN hours < 1 THEN '<1h' WHEN hours < 3 THEN '1-3h' WHEN hours < 6 THEN '3-6h' WHEN hours < 12 THEN '6-12h' WHEN hours < 24 THEN '12-24h' WHEN hours < 72 THEN '1-3d' ELSE '3-7d' END AS time_bucket, side, price, CASE WHEN volume = 0 THEN 'dead' WHEN volume <= 100 THEN 'low' WHEN volume <= 1000 THEN 'moderate' WHEN volume <= 10000 THEN 'active' ELSE 'high' END AS vol_bucket, CASE WHEN result = side THEN 'won' ELSE 'lost' END AS outcome, flow FROM ({union}))
""".format(
    sums=", ".join(f"coalesce(sum(t.count) FILTER (WHERE t.ts_us > p.at_us AND {c}), 0) AS {s}_{p}" for s in ("yes", "no") for p in range(85, 98) for c in [f"t.taker_side = 'no' AND t.yes_cents <= {p}" if s == "yes" else f"t.taker_side = 'yes' AND t.yes_cents >= {100 - p}"]),
    union=" UNION ALL ".join(f"SELECT gp, topic, hours, volume, result, '{s}' AS side, {p} AS price, {s}_{p} AS flow FROM v" for s in ("yes", "no") for p in range(85, 98)),
)


def _flow(m):
    return W.flow_observations(m.tape, m.tape_markets)


@query(FLOW_SQL + "SELECT gp, topic, time_bucket, side, vol_bucket, CAST(price AS INTEGER) AS price, outcome, CAST(count(*) AS BIGINT) AS n, CAST(sum(flow) AS BIGINT) AS flow FROM o GROUP BY ALL", "tape_markets")
def c08_flow_observations(m):
    return _flow(m).groupBy("gp", "topic", "time_bucket", "side", "vol_bucket", "price", "outcome").agg(F.count("*").alias("n"), F.sum("flow").cast("bigint").alias("flow"))


FLOW_LEVELS_SQL = (
    FLOW_SQL
    + """, c AS (SELECT *, CASE WHEN time_bucket IN ('<1h', '1-3h', '3-6h') THEN 'short' WHEN time_bucket IN ('6-12h', '12-24h') THEN 'medium' ELSE 'long' END AS coarse FROM o),
l AS (SELECT 1 AS level, gp, topic, time_bucket, side, vol_bucket, CAST(price AS VARCHAR) AS price, outcome, flow FROM c UNION ALL SELECT 2, gp, topic, time_bucket, side, '*', CAST(price AS VARCHAR), outcome, flow FROM c UNION ALL SELECT 3, gp, topic, coarse, side, '*', CAST(price AS VARCHAR), outcome, flow FROM c
UNION ALL SELECT 4, gp, topic, coarse, side, '*', '*', outcome, flow FROM c UNION ALL SELECT 5, gp, topic, coarse, side, '*', '*', '*', flow FROM c UNION ALL SELECT 6, gp, topic, coarse, '*', '*', '*', '*', flow FROM c),
"""
)


@query(
    FLOW_LEVELS_SQL
    + """t AS (SELECT level, gp, topic, time_bucket, side, vol_bucket, price, outcome, CAST(count(*) AS BIGINT) AS n_outcome, CAST(sum(CASE WHEN flow >= 1 THEN 1 ELSE 0 END) AS BIGINT) / CAST(count(*) AS DOUBLE) AS p1, CAST(sum(CASE WHEN flow >= 50 THEN 1 ELSE 0 END) AS BIGINT) / CAST(count(*) AS DOUBLE) AS p50, CAST(sum(CASE WHEN flow >= 500 THEN 1 ELSE 0 END) AS BIGINT) / CAST(count(*) AS DOUBLE) AS p500 FROM l GROUP BY ALL)
SELECT *, CAST(sum(n_outcome) OVER (PARTITION BY level, gp, topic, time_bucket, side, vol_bucket, price) AS BIGINT) AS n_observations FROM t""",
    "tape_markets",
)
def c08_flow_table(m):
    out = W.flow_table(_flow(m))
    return out.select("level", "gp", "topic", "time_bucket", "side", "vol_bucket", "price", "outcome", "n_outcome", "n_observations", F.col("exceed")[0].alias("p1"), F.col("exceed")[4].alias("p50"), F.col("exceed")[7].alias("p500"))


def _curve_sql(e: str, n: str) -> str:
    """The chance of a quantity on a list of exceedances at the thresholds of flow, as SQL: straight in the logarithm between two of them."""
    at = W.THRESHOLDS
    line = lambda i, j: f"{e}[{i}] + ({e}[{j}] - {e}[{i}]) * (ln(quantity) - ln({at[i - 1]})) / (ln({at[j - 1]}) - ln({at[i - 1]}))"
    between = " ".join(f"WHEN quantity < {at[i]} THEN {line(i, i + 1)}" for i in range(1, len(at)))
    last = len(at)
    on = f"CASE WHEN {e}[{last - 1}] > 0 AND {e}[{last}] > 0 THEN greatest(0, {line(last - 1, last)}) ELSE 0 END"
    return f"CASE WHEN quantity <= 0 THEN 1 WHEN quantity <= {at[0]} THEN {e}[1] {between} WHEN quantity = {at[-1]} THEN {e}[{last}] WHEN quantity > {2 * at[-1]} THEN 0 WHEN {n} >= 200 THEN {on} ELSE {e}[{last}] END"


# markets of both results in each group, so that levels which need won and lost ones are found too
MIXED_SQL = FLOW_LEVELS_SQL.replace("tape_markets k", "(SELECT * REPLACE ('G' || (CAST(substr(ticker, 2) AS BIGINT) // 4 % 2) AS gp) FROM tape_markets) k")
FILL_PROBABILITY_SQL = f"""{MIXED_SQL}t AS (SELECT level, gp, topic, time_bucket, side, vol_bucket, price, outcome, count(*) AS n, [{", ".join(f"avg(CASE WHEN flow >= {t} THEN 1.0::DOUBLE ELSE 0 END)" for t in W.THRESHOLDS)}] AS e FROM l GROUP BY ALL),
g AS (SELECT level, gp, topic, time_bucket, side, vol_bucket, price, sum(n) AS n, max(n) FILTER (WHERE outcome = 'won') AS n_won, max(n) FILTER (WHERE outcome = 'lost') AS n_lost, any_value(e) FILTER (WHERE outcome IN ('won', '*')) AS ew, any_value(e) FILTER (WHERE outcome IN ('lost', '*')) AS el FROM t GROUP BY ALL),
h AS (SELECT * FROM g WHERE n >= 200 AND (level > 4 OR n_won >= 50 AND n_lost >= 50)),
q AS (SELECT *, CASE WHEN tb IN ('<1h', '1-3h', '3-6h') THEN 'short' WHEN tb IN ('6-12h', '12-24h') THEN 'medium' ELSE 'long' END AS cb FROM (SELECT trade_id AS order_id, 'G' || (user_id // 4 % 2) AS gp, 'T' || ((user_id // 2) % 2) AS topic, taker_side AS side, (trade_id * 7) % 1300 - 20 AS quantity, CAST(85 + trade_id % 13 AS VARCHAR) AS price,
  CASE WHEN h < 1 THEN '<1h' WHEN h < 3 THEN '1-3h' WHEN h < 6 THEN '3-6h' WHEN h < 12 THEN '6-12h' WHEN h < 24 THEN '12-24h' WHEN h < 72 THEN '1-3d' ELSE '3-7d' END AS tb, CASE WHEN v = 0 THEN 'dead' WHEN v <= 100 THEN 'low' WHEN v <= 1000 THEN 'moderate' WHEN v <= 10000 THEN 'active' ELSE 'high' END AS vb FROM (SELECT *, trade_id % 200 AS h, count - 1 AS v FROM tape))),
best AS (SELECT q.*, h.level, h.n, h.ew, h.el FROM q LEFT JOIN h ON q.gp = h.gp AND q.topic = h.topic AND h.time_bucket = CASE WHEN h.level <= 2 THEN tb ELSE cb END AND h.side IN (q.side, '*') AND h.vol_bucket IN (vb, '*') AND h.price IN (q.price, '*') QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY level) = 1)
SELECT order_id, level, round({_curve_sql("ew", "n")}, 9) AS p_won, round({_curve_sql("el", "n")}, 9) AS p_lost FROM best"""


@query(FILL_PROBABILITY_SQL, "tape_markets")
def j17_fill_probability(m):
    """Each print as an order at every limit, size and horizon in turn, quantities below zero and over twice the last threshold among them."""
    t, group = F.col("trade_id"), lambda user: F.concat(F.lit("G"), F.floor(user / 4) % 2)
    markets = m.tape_markets.withColumn("gp", group(F.substring("ticker", 2, 20).cast("bigint")))
    orders = m.tape.select(t.alias("order_id"), group(F.col("user_id")).alias("gp"), F.concat(F.lit("T"), F.floor(F.col("user_id") / 2) % 2).alias("topic"), (t % 200).cast("double").alias("hours"), F.col("taker_side").alias("side"), (t * 7 % 1300 - 20).cast("int").alias("quantity"), (85 + t % 13).cast("int").alias("limit"), (F.col("count") - 1).alias("volume"))
    return W.fill_probability(orders, W.flow_table(W.flow_observations(m.tape, markets))).select("order_id", "level", F.round("p_won", 9).alias("p_won"), F.round("p_lost", 9).alias("p_lost"))


@query("SELECT ticker, period_us, seq, l.p AS lim, ask <= l.p OR volume > 0 AND volume <= l.p AS yes_touch, 100 - bid <= l.p OR volume > 0 AND 100 - volume <= l.p AS no_touch FROM candles, (VALUES (10), (60)) l(p)", "candles")
def m01_touches(m):
    grid = m.candles.withColumn("lim", F.explode(F.array(F.lit(10), F.lit(60))))
    t = lambda s: X.touched(F.lit(s), F.col("lim"), F.col("bid"), F.col("ask"), F.col("volume"), F.col("volume"))
    return grid.select("ticker", "period_us", "seq", "lim", t("yes").alias("yes_touch"), t("no").alias("no_touch"))


QUEUE_SQL = """WITH q AS (SELECT trade_id AS order_id, ticker, CASE WHEN trade_id % 40 = 0 THEN 'yes' ELSE 'no' END AS side, 90 AS lim, 30 AS quantity, 20 AS ahead, ts_us AS placed_us, ts_us + 864000000000 AS end_us FROM tape),
h AS (SELECT q.*, t.ts_us, t.trade_id, t.count AS v, CASE WHEN side = 'yes' THEN yes_cents < lim ELSE 100 - yes_cents < lim END AS past FROM q JOIN tape t ON q.ticker = t.ticker AND t.ts_us BETWEEN q.placed_us AND q.end_us WHERE side = 'yes' AND taker_side = 'no' AND yes_cents <= lim OR side = 'no' AND taker_side = 'yes' AND yes_cents >= 100 - lim),
w AS (SELECT *, max(CAST(past AS INTEGER)) OVER (PARTITION BY order_id ORDER BY ts_us, trade_id) = 1 AS swept FROM h),
r AS (SELECT *, least(quantity, greatest(0, sum(CASE WHEN swept THEN 0 ELSE v END) OVER x - ahead) + sum(CASE WHEN swept THEN v ELSE 0 END) OVER x) AS filled FROM w WINDOW x AS (PARTITION BY order_id ORDER BY ts_us, trade_id)),
d AS (SELECT order_id, ts_us, filled, filled - coalesce(lag(filled) OVER (PARTITION BY order_id ORDER BY ts_us, trade_id), 0) AS fill FROM r)
SELECT q.order_id, CAST(coalesce(sum(fill), 0) AS BIGINT) AS filled, (min(ts_us) FILTER (WHERE fill > 0) - any_value(q.placed_us)) / 1e6 AS first_s FROM q LEFT JOIN d ON q.order_id = d.order_id GROUP BY q.order_id"""


@query(QUEUE_SQL, "tape")
def m05_queue_simulator(m):
    """Each print as an order; prints are dealt out by market, and what is made of them stays in its task."""
    tape = dealt(m.tape.drop("user_id", "event_type"), m.raw("events").count(), "ticker", rows_a_task=20_000)
    orders = tape.select(F.col("trade_id").alias("order_id"), "ticker", F.when(F.col("trade_id") % 40 == 0, "yes").otherwise("no").alias("side"), F.lit(90).alias("limit"), F.lit(30).alias("quantity"), F.lit(20).alias("ahead"), F.col("ts_us").alias("placed_us"), (F.col("ts_us") + 864_000_000_000).alias("end_us"))
    return W.queue_summary(orders, tape).select("order_id", F.col("filled").cast("bigint").alias("filled"), "first_s")


def _candidates(m):
    # rates, fill rates and quotes all read the observations: they are joined once
    m.observations = written(m.observations, "observations")
    rates = _rates(m, 20).groupBy("gp", "topic", "price_bucket").agg(F.avg("p_yes").alias("p_event"))
    quotes = m.observations.withColumn("price_bucket", X.price_bucket(F.col("mid"))).join(rates, ["gp", "topic", "price_bucket"])
    return S.ev_scan(quotes.select("ticker", "event_ticker", "gp", "topic", "hours", "bid", "ask", "p_event", "period_us", "seq", "result", "settled_us"), _fill_rates(m))


EXACT = "sum(p_raw * n_markets) OVER w / sum(n_markets) OVER w"
SCAN_SQL = f"""WITH rates AS ({RATES_SQL.replace(">= 50", ">= 20").replace(f"round({EXACT}, 9)", EXACT)}), fills AS ({FILLS_SQL}),
pe AS (SELECT gp, topic, price_bucket, avg(p_yes) AS p_event FROM rates GROUP BY ALL),
c AS (SELECT o.event_ticker, o.ticker, f.side, f.step, f.rate_won, f.rate_lost, CASE f.side WHEN 'yes' THEN p_event ELSE 1 - p_event END AS p,
  CASE f.side WHEN 'yes' THEN bid ELSE 100 - ask END + CAST(round_even((f.step / 10.0::DOUBLE) * (ask - bid), 0) AS INTEGER) AS lim
  FROM observations o JOIN pe ON o.gp = pe.gp AND o.topic = pe.topic AND o.mid2 // 10 = pe.price_bucket
  JOIN fills f ON o.gp = f.gp AND o.topic = f.topic AND f.time_bucket = CASE WHEN hours < 1 THEN '<1h' WHEN hours < 3 THEN '<3h' WHEN hours < 6 THEN '<6h' WHEN hours < 12 THEN '<12h' WHEN hours < 24 THEN '<24h' WHEN hours < 72 THEN '<72h' WHEN hours < 168 THEN '<168h' ELSE '>168h' END WHERE ask > bid),
e AS (SELECT *, round(p * rate_won * (100 - lim - fee) - (1 - p) * rate_lost * (lim + fee), 9) AS ev FROM (SELECT *, {FEE.format(c="lim", q=1)} AS fee FROM c) WHERE lim > 0),
t AS (SELECT * FROM e WHERE ev > 0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ev DESC, side DESC, step, lim) = 1),
s AS (SELECT *, least(5, greatest(1, 400 // lim)) AS contracts FROM t)
SELECT event_ticker, ticker, side, lim AS "limit", CAST(contracts AS INTEGER) AS contracts, round(ev * contracts, 6) AS total_ev FROM s QUALIFY row_number() OVER (PARTITION BY event_ticker ORDER BY ev * contracts DESC, ticker) = 1"""


@query(SCAN_SQL.replace('AS "limit"', "AS limit_cents"), "observations")
def r01_ev_scan(m):
    """Each event's best order among all its quotes."""
    return _candidates(m).select("event_ticker", "ticker", "side", F.col("limit").alias("limit_cents"), "contracts", F.round("total_ev", 6).alias("total_ev"))


@query()
def r08_replay(m):
    """A replay for each process and month of placement, so that scenarios grow with the data. Sequential within one: tests hold it against a loop over events."""
    c = _candidates(m).withColumn("scenario", F.concat_ws(" ", "gp", F.date_format(F.timestamp_micros("period_us"), "yyyy-MM")))
    rows = c.select("scenario", "period_us", F.lit(0).alias("rank"), "ticker", "event_ticker", "side", F.col("limit").alias("price"), "contracts", F.col("contracts").alias("filled"), F.col("period_us").alias("filled_us"), "settled_us", "result")
    return S.replay(rows, 10_000, S.Limits())
