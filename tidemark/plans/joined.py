"""Joins."""

from pyspark.sql import functions as F

from tidemark.operators import calibration as C
from tidemark.operators import flow as W
from tidemark.operators import joins as J
from tidemark.operators import sinks as K
from tidemark.operators import strategy as S
from tidemark.plans.catalog import query

ASOF = "SELECT s.ticker, s.event_ticker, s.result, s.settled_us, c.bid, c.ask, c.volume, c.period_us FROM settled s LEFT JOIN (SELECT s.ticker, c.bid, c.ask, c.volume, c.period_us, row_number() OVER (PARTITION BY s.ticker ORDER BY c.period_us DESC, c.seq DESC) AS rn FROM settled s JOIN candles c ON s.ticker = c.ticker AND c.period_us < s.settled_us AND c.ask - c.bid <= 20) c ON s.ticker = c.ticker AND rn = 1"


@query("SELECT gp, CAST(mid2 // 10 AS INTEGER) AS price_bucket, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(yes AS INTEGER)) AS BIGINT) AS n_yes, CAST(sum(mid2) AS BIGINT) AS mid2_sum FROM observations GROUP BY ALL", "observations")
def j01_calibration_curve(m):
    from tidemark.functions.exprs import price_bucket

    return m.observations.groupBy("gp", price_bucket(F.col("mid")).alias("price_bucket")).agg(F.count("*").alias("n"), F.sum(F.col("yes").cast("int")).alias("n_yes"), F.sum("mid2").cast("bigint").alias("mid2_sum"))


@query("SELECT s.ticker, coalesce(gp, 'unknown') AS gp, coalesce(topic, 'unknown') AS topic FROM settled s LEFT JOIN (SELECT * FROM classes WHERE gp <> 'ASIA') c ON s.series = c.series", "settled", "classes")
def j02_classify(m):
    known = m.classes.where("gp <> 'ASIA'")
    return m.settled.join(known, "series", "left").select("ticker", F.coalesce("gp", F.lit("unknown")).alias("gp"), F.coalesce("topic", F.lit("unknown")).alias("topic"))


@query(ASOF, "candles")
def j03_asof_last_before(m):
    tight = m.candles.where("ask - bid <= 20")
    left = m.settled.select("ticker", "event_ticker", "result", "settled_us")
    return J.asof_last(left, tight, "ticker", "settled_us", "period_us", ["bid", "ask", "volume"], tie=["seq"]).withColumnRenamed("matched_at", "period_us")


@query("SELECT t.ticker, h.at_us, last(yes_cents ORDER BY ts_us, trade_id) AS yes_cents FROM (SELECT ticker, settled_us - 3600000000 * g.i AS at_us FROM tape_markets, range(0, 100, 10) g(i)) h JOIN tape t ON h.ticker = t.ticker AND t.ts_us <= h.at_us GROUP BY ALL", "tape_markets")
def j19_asof_at_or_before(m):
    at = m.tape_markets.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(90), F.lit(10)))).select("ticker", (F.col("settled_us") - 3_600_000_000 * F.col("i")).alias("at_us"))
    return J.asof_last(at, m.tape, "ticker", "at_us", "ts_us", ["yes_cents"], strict=False, tie=["trade_id"]).where("matched_at IS NOT NULL").drop("matched_at")


FALLBACK_SQL = """WITH e AS (SELECT DISTINCT event_ticker, series FROM settled WHERE o_orderkey % 3 = 0),
k AS (SELECT series, CASE WHEN series < 'S2' THEN NULL ELSE gp END AS gp, topic FROM classes WHERE topic <> 'T1' UNION ALL SELECT 'KX' || series, gp, NULL FROM classes)
SELECT s.ticker, coalesce(a.gp, b.gp, c.gp) AS gp, coalesce(a.topic, b.topic, c.topic) AS topic FROM settled s LEFT JOIN e ON s.event_ticker = e.event_ticker
LEFT JOIN k a ON e.series = a.series LEFT JOIN k b ON 'KX' || split_part(s.ticker, '-', 1) = b.series LEFT JOIN k c ON split_part(s.ticker, '-', 1) = c.series"""


@query(FALLBACK_SQL, "settled", "classes")
def j06_fallback_classes(m):
    plain = m.classes.where("topic <> 'T1'").select("series", F.when(F.col("series") >= "S2", F.col("gp")).alias("gp"), "topic")
    known = plain.unionByName(m.classes.select(F.concat(F.lit("KX"), "series").alias("series"), "gp", F.lit(None).cast("string").alias("topic")))
    events = m.settled.where("o_orderkey % 3 = 0").select("event_ticker", "series").distinct()
    return J.class_of(m.settled.select("ticker", "event_ticker"), events, known).select("ticker", "gp", "topic")


@query("SELECT s.ticker, s.event_ticker, e.category AS event_category, e.title AS event_title FROM settled s LEFT JOIN (SELECT DISTINCT 'S' || c_nationkey || '-' || c_custkey AS event_ticker, c_mktsegment AS category, c_name AS title FROM customer WHERE c_custkey % 5 > 0) e ON s.event_ticker = e.event_ticker", "settled")
def j07_event_titles(m):
    """Markets with category and title of their event, where that has been collected; some events are stored twice."""
    events = m.raw("customer").where("c_custkey % 5 > 0").select(F.concat(F.lit("S"), "c_nationkey", F.lit("-"), "c_custkey").alias("event_ticker"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("title"), F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 2).cast("int"))))
    return J.with_event(m.settled.select("ticker", "event_ticker"), events, event_category="category", event_title="title")


MATERIAL_SQL = f"""WITH last AS ({ASOF}), far AS (SELECT ticker, max(period_us) AS period_us FROM candles GROUP BY ticker)
SELECT l.ticker, l.event_ticker, l.result, l.settled_us, bid, ask, (l.settled_us - l.period_us) / 3.6e9 AS hours, CASE WHEN bid IS NULL THEN 'none' ELSE 'candle' END AS source, coalesce(gp, 'unknown') AS gp, coalesce(topic, 'unknown') AS topic
FROM last l LEFT JOIN classes k ON split_part(l.ticker, '-', 1) = k.series WHERE l.result IS NOT NULL"""


@query(MATERIAL_SQL, "candles", "classes")
def j08_materialization(m):
    """Settled markets with their last quote before settlement and class: the weekly table."""
    left = m.settled.where("result IS NOT NULL").select("ticker", "event_ticker", "series", "result", "settled_us")
    priced = J.asof_last(left, m.candles.where("ask - bid <= 20"), "ticker", "settled_us", "period_us", ["bid", "ask"], tie=["seq"])
    known = priced.join(m.classes, "series", "left")
    hours = (F.col("settled_us") - F.col("matched_at")) / F.lit(3.6e9)
    return known.select("ticker", "event_ticker", "result", "settled_us", "bid", "ask", hours.alias("hours"), F.when(F.col("bid").isNull(), "none").otherwise("candle").alias("source"), F.coalesce("gp", F.lit("unknown")).alias("gp"), F.coalesce("topic", F.lit("unknown")).alias("topic"))


@query(
    """SELECT ticker, coalesce(nullif(s.category, ''), nullif(a.gp, ''), nullif(b.gp, ''), nullif(e.gp, '')) AS category FROM (SELECT ticker, event_ticker, series, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' END AS category FROM settled) s
    LEFT JOIN (SELECT * FROM classes WHERE topic = 'T0') a ON s.series = a.series LEFT JOIN (SELECT * FROM classes WHERE topic = 'T1') b ON s.series = b.series LEFT JOIN (SELECT event_ticker, min(o_orderpriority) AS gp FROM settled GROUP BY event_ticker) e ON s.event_ticker = e.event_ticker""",
    "settled",
    "classes",
)
def j09_category_passes(m):
    rows = m.settled.select("ticker", "event_ticker", "series", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 4 == 1, "").alias("category"))
    by_event = m.settled.groupBy("event_ticker").agg(F.min("o_orderpriority").alias("gp"))
    passes = [(m.classes.where("topic = 'T0'"), [(F.col("series"), "series")], "gp"), (m.classes.where("topic = 'T1'"), [(F.col("series"), "series")], "gp"), (by_event, [(F.col("event_ticker"), "event_ticker")], "gp")]
    return J.filled_by_passes(rows, "category", passes).select("ticker", "category")


@query("SELECT event_type AS dataset_id, max(event_id) AS last_run, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def j10_latest_run(m):
    return J.first_of(m.raw("events"), ["event_type"], F.col("event_id").desc()).select(F.col("event_type").alias("dataset_id"), F.col("event_id").alias("last_run"), "value")


@query("WITH h AS (SELECT DISTINCT l_partkey AS part, CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem), g AS (SELECT part, CAST(unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month FROM h GROUP BY part) SELECT part, strftime(g.month, '%Y-%m') AS month FROM g ANTI JOIN h USING (part, month)")
def j11_missing_months(m):
    rows = m.raw("lineitem").select(F.col("l_partkey").alias("part"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at_us"))
    return J.missing_months(rows, "at_us", "part").select("part", F.date_format("month", "yyyy-MM").alias("month"))


@query("SELECT ticker FROM settled s WHERE EXISTS (SELECT 1 FROM candles c WHERE c.ticker = s.ticker AND c.volume > 50 AND c.period_us < s.settled_us)", "candles")
def j12_semi_before_close(m):
    c = m.candles.where("volume > 50").groupBy(F.col("ticker").alias("t")).agg(F.min("period_us").alias("first_us"))
    return m.settled.join(c, (F.col("ticker") == F.col("t")) & (F.col("first_us") < F.col("settled_us")), "left_semi").select("ticker")


@query("SELECT DISTINCT series FROM settled WHERE series NOT IN (SELECT series FROM classes WHERE topic = 'T2')", "settled", "classes")
def j14_unclassified(m):
    return m.settled.select("series").distinct().join(m.classes.where("topic = 'T2'"), "series", "left_anti")


BANDS = "SELECT * FROM (VALUES (0, 0.0, 100.0), (1, 100.0, 2000.0), (2, 3000.0, 9000.0)) b(bucket_index, h_from, h_to)"


@query(f"SELECT ticker, period_us, seq, min(b.bucket_index) AS bucket_index FROM observations o LEFT JOIN ({BANDS}) b ON o.hours BETWEEN b.h_from AND b.h_to GROUP BY ALL", "observations")
def j15_band_lookup(m):
    bands = m.spark.createDataFrame([(g, i, a, b) for g in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST") for i, a, b in ((0, 0.0, 100.0), (1, 100.0, 2000.0), (2, 3000.0, 9000.0))], "gp string, bucket_index int, h_from double, h_to double")
    return J.band(m.observations, bands, ["gp"], "hours", "h_from", "h_to", "bucket_index", ["bucket_index"]).select("ticker", "period_us", "seq", "bucket_index").distinct()


@query("SELECT s.ticker, coalesce(a.n, b.n, c.n) AS n, CASE WHEN a.n IS NOT NULL THEN 1 WHEN b.n IS NOT NULL THEN 2 ELSE 3 END AS level FROM settled s LEFT JOIN (SELECT event_ticker, CAST(count(*) AS BIGINT) AS n FROM settled GROUP BY 1 HAVING count(*) >= 20) a ON s.event_ticker = a.event_ticker LEFT JOIN (SELECT series, CAST(count(*) AS BIGINT) AS n FROM settled GROUP BY 1 HAVING count(*) >= 500) b ON s.series = b.series, (SELECT CAST(count(*) AS BIGINT) AS n FROM settled) c", "settled")
def j17_fallback_levels(m):
    by = lambda k, least: m.settled.groupBy(k).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    levels = [(by("event_ticker", 20), ["event_ticker"]), (by("series", 500), ["series"]), (m.settled.agg(F.count("*").alias("n")), [])]
    return J.fallback(m.settled.select("ticker", "event_ticker", "series"), levels, ["n"]).select("ticker", "n", "level")


@query("SELECT n_nationkey, CASE WHEN x <= 0.2 THEN 10.0 WHEN x >= 0.8 THEN 40.0 ELSE 10.0 + (x - 0.2) / (0.8 - 0.2) * (40.0 - 10.0) END AS v FROM (SELECT n_nationkey, n_nationkey / 24.0 AS x FROM nation)")
def j18_interpolate(m):
    points = m.spark.createDataFrame([(1, 0.2, 10.0), (1, 0.8, 40.0)], "k int, x double, v double")
    left = m.raw("nation").select(F.lit(1).alias("k"), "n_nationkey", (F.col("n_nationkey") / F.lit(24.0)).alias("q"))
    return J.interpolated(left, points, ["k"], "q", "x", ["v"]).select("n_nationkey", "v")


@query("SELECT event_ticker, y, n, total FROM (SELECT a.event_ticker, a.o_orderkey AS y, b.o_orderkey AS n, CAST(floor(a.o_totalprice) AS BIGINT) + CAST(floor(b.o_totalprice) AS BIGINT) AS total, row_number() OVER (PARTITION BY a.event_ticker ORDER BY CAST(floor(a.o_totalprice) AS BIGINT) + CAST(floor(b.o_totalprice) AS BIGINT) DESC, a.o_orderkey, b.o_orderkey) AS rn FROM settled a JOIN settled b ON a.event_ticker = b.event_ticker AND a.o_orderkey < b.o_orderkey WHERE a.result = 'yes' AND b.result = 'no') WHERE rn = 1", "settled")
def j21_best_pairs(m):
    legs = m.settled.where("result IS NOT NULL").select("event_ticker", "result", F.col("o_orderkey").alias("order"), F.col("o_orderkey").alias("key"), F.floor("o_totalprice").alias("v"))
    return S.best_ordered_pair(legs, "event_ticker", "result", "order", "v", "key").select("event_ticker", F.col("y_key").alias("y"), F.col("n_key").alias("n"), (F.col("y_v") + F.col("n_v")).alias("total"))


@query("SELECT s.ticker, d.side, d.step FROM settled s, (SELECT unnest(['yes', 'no']) AS side) x, LATERAL (SELECT x.side AS side, unnest(range(0, 11)) AS step) d", "settled")
def j22_price_grid(m):
    sides, steps = F.explode(F.array(F.lit("yes"), F.lit("no"))), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(10).cast("bigint")))
    return m.settled.select("ticker").withColumn("side", sides).withColumn("step", steps)


@query("SELECT ticker, coalesce(result, first_result) AS result FROM settled s LEFT JOIN (SELECT series, arg_min(result, o_orderkey) AS first_result FROM settled WHERE result IS NOT NULL GROUP BY series) f ON s.series = f.series", "settled")
def j23_sibling_fill(m):
    first = m.settled.where("result IS NOT NULL").groupBy("series").agg(F.min_by("result", "o_orderkey").alias("first_result"))
    return m.settled.join(first, "series", "left").select("ticker", F.coalesce("result", "first_result").alias("result"))


@query("SELECT a.user_id, a.value AS edge, CAST(count(*) AS BIGINT) AS settlements FROM (SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id) a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'error' WHERE a.value > 10 GROUP BY ALL")
def j24_log_self_join(m):
    e = m.raw("events")
    placed = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("edge")).where("edge > 10")
    return placed.join(e.where("event_type = 'error'").select("user_id"), "user_id").groupBy("user_id", "edge").agg(F.count("*").alias("settlements"))


@query("SELECT l_suppkey, arg_max(l_partkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS last_part FROM lineitem GROUP BY l_suppkey")
def j26_latest_value(m):
    return m.raw("lineitem").groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("last_part"))


@query("SELECT h.ticker, h.at_us, CAST(coalesce(sum(t.count), 0) AS BIGINT) AS volume FROM (SELECT ticker, settled_us - 3600000000 * g.i AS at_us FROM tape_markets, range(0, 200, 20) g(i)) h LEFT JOIN tape t ON h.ticker = t.ticker AND t.ts_us >= h.at_us - 86400000000 AND t.ts_us < h.at_us GROUP BY ALL", "tape_markets")
def j27_trailing_volume(m):
    at = m.tape_markets.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(180), F.lit(20)))).select("ticker", (F.col("settled_us") - 3_600_000_000 * F.col("i")).alias("at_us"))
    return W.trailing_volume(m.tape, at)


@query("SELECT a.ticker, b.result AS settled_result, coalesce(b.result, a.o_orderpriority) AS structure FROM settled a FULL JOIN (SELECT * FROM settled WHERE result = 'yes') b ON a.ticker = b.ticker", "settled")
def q31_structure_map(m):
    won = m.settled.where("result = 'yes'").select("ticker", F.col("result").alias("settled_result"))
    return m.settled.join(won, "ticker", "full").select("ticker", "settled_result", F.coalesce("settled_result", "o_orderpriority").alias("structure"))


SPLICE_SQL = """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS l, l_partkey AS v, l_returnflag <> 'N' AS historical FROM lineitem),
stored AS (SELECT k, l, arg_max(v, (historical, v)) AS v, bool_or(historical) AS historical FROM r WHERE v % 2 = 0 GROUP BY ALL),
past AS (SELECT k, l, max(v) AS v FROM r WHERE v % 2 = 1 AND historical GROUP BY ALL), live AS (SELECT k, l, max(v) AS v FROM r WHERE v % 2 = 1 AND NOT historical GROUP BY ALL),
-- a historical row is inserted, or updates only where the stored origin is live; a live row is inserted or ignored
after_past AS (SELECT coalesce(s.k, p.k) AS k, coalesce(s.l, p.l) AS l, CASE WHEN s.k IS NULL OR NOT s.historical AND p.k IS NOT NULL THEN p.v ELSE s.v END AS v FROM stored s FULL JOIN past p ON s.k = p.k AND s.l = p.l)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.l, b.l) AS l, coalesce(a.v, b.v) AS v FROM after_past a FULL JOIN live b ON a.k = b.k AND a.l = b.l"""


@query(SPLICE_SQL)
def k01_splice(m):
    """Historical rows replace stored live ones of the same key; stored historical ones stay, and live ones never replace."""
    rows = m.raw("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("v"), F.when(F.col("l_returnflag") == "N", "live").otherwise("historical").alias("origin"))
    old, new = rows.where("v % 2 = 0"), rows.where("v % 2 = 1")
    return K.splice(old, new, ["k", "l"], "origin", F.col("v").desc()).select("k", "l", "v")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || '!' ELSE c_mktsegment END AS segment, greatest(c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 10 END) AS nation FROM customer")
def k06_coalescing_upsert(m):
    old = m.raw("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    new = old.where("c_custkey % 3 <> 1").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("segment", F.lit("!"))).otherwise("").alias("segment"), F.when(F.col("c_custkey") % 3 == 0, 10).alias("nation"))
    return K.coalescing_upsert(old, new, ["c_custkey"], text=["segment"], most=["nation"])


@query("SELECT c_custkey, c_custkey % 5 = 0 AS superseded FROM customer")
def k07_supersede(m):
    current = m.raw("customer").where("c_custkey % 5 <> 0").select("c_custkey")
    live = m.raw("customer").select("c_custkey", F.lit(None).cast("bigint").alias("superseded_at"))
    return K.supersede(live, current, ["c_custkey"], "superseded_at", F.lit(99)).select("c_custkey", F.col("superseded_at").isNotNull().alias("superseded"))


@query("SELECT o_orderkey, CASE WHEN n IS NULL THEN 'cancelled' WHEN n >= 4 THEN 'filled' ELSE 'partial' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def k21_order_status(m):
    fills = m.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), F.lit(1).alias("count"))
    orders = m.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.lit(4).alias("quantity"))
    return K.order_status(orders, fills).select(F.col("order_id").alias("o_orderkey"), "status")
