"""Status reports, checks of each dataset, stores and copies, backtests with edges; each over whole tables and with its SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import calibration as C
from tidemark.operators import flow as W
from tidemark.operators import health as H
from tidemark.operators import joins as J
from tidemark.operators import sinks as K
from tidemark.operators import strategy as S
from tidemark.operators import track as T
from tidemark.plans.catalog import query

END = 904608000000000  # 1998-09-01
DAY = 86_400_000_000


def _n(*conditions):
    return [F.count_if(c).alias(name) for name, c in conditions]


@query("SELECT CAST(count(*) AS BIGINT) AS series, CAST(count(k.gp) AS BIGINT) AS classified, CAST(count(*) FILTER (WHERE k.gp IS NULL OR k.topic = 'T0') AS BIGINT) AS review, count(DISTINCT k.topic) AS categories FROM (SELECT DISTINCT series FROM settled) s LEFT JOIN (SELECT * FROM classes WHERE series <> 'S7') k ON s.series = k.series", "settled", "classes")
def q02_pipeline_status(m):
    """Series against classified ones, those to review, and categories, in one pass."""
    joined = m.settled.select("series").distinct().join(m.classes.where("series <> 'S7'"), "series", "left")
    return joined.agg(F.count("*").alias("series"), F.count("gp").alias("classified"), F.count_if(F.col("gp").isNull() | (F.col("topic") == "T0")).alias("review"), F.count_distinct("topic").alias("categories"))


@query("SELECT CAST(count(*) FILTER (WHERE result IS NULL) AS BIGINT) AS before, CAST(count(*) FILTER (WHERE coalesce(result, first_result) IS NULL) AS BIGINT) AS after FROM settled s LEFT JOIN (SELECT series, arg_min(result, o_orderkey) AS first_result FROM settled WHERE result IS NOT NULL GROUP BY series) f ON s.series = f.series", "settled")
def q03_step_counts(m):
    """Missing categories before and after a step that fills them from siblings."""
    first = m.settled.where("result IS NOT NULL").groupBy("series").agg(F.min_by("result", "o_orderkey").alias("first_result"))
    joined = m.settled.join(first, "series", "left")
    return joined.agg(*_n(("before", F.col("result").isNull()), ("after", F.coalesce("result", "first_result").isNull())))


@query("SELECT gp, topic, origin AS model, CAST(count(*) AS BIGINT) AS n, round(avg(mid), 6) AS confidence, CAST(count(*) FILTER (WHERE mid < 0.2) AS BIGINT) AS review FROM observations GROUP BY ALL", "observations")
def q04_classifier_status(m):
    by = m.observations.groupBy("gp", "topic", F.col("origin").alias("model"))
    return by.agg(F.count("*").alias("n"), F.round(F.avg("mid"), 6).alias("confidence"), F.count_if(F.col("mid") < 0.2).alias("review"))


@query("""SELECT series, 'Series: ' || series || chr(10) || 'Events: ' || list_aggregate(list(event_ticker ORDER BY event_ticker)[:3], 'string_agg', '; ') || chr(10) || 'Rules: ' || substr(repeat(min(event_ticker) || ' ', 100), 1, 800) AS prompt FROM (SELECT DISTINCT series, event_ticker FROM settled) GROUP BY series""", "settled")
def q06_prompts(m):
    """Prompt text of each series: three titles and the rules, cut to 800 characters. The few first events of a series come from a rank, not from a list of all."""
    events = m.settled.select("series", "event_ticker").distinct()
    rank = events.withColumn("r", F.row_number().over(Window.partitionBy("series").orderBy("event_ticker"))).where("r <= 3")
    some = rank.groupBy("series").agg(F.array_sort(F.collect_list("event_ticker")).alias("titles"))
    rules = F.substring(F.repeat(F.concat(F.col("titles")[0], F.lit(" ")), 100), 1, 800)
    return some.select("series", F.concat_ws("\n", F.concat(F.lit("Series: "), "series"), F.concat(F.lit("Events: "), F.array_join("titles", "; ")), F.concat(F.lit("Rules: "), rules)).alias("prompt"))


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY series ORDER BY o_orderkey) - 1) // 5 AS BIGINT) AS batch FROM settled", "settled")
def q07_batches(m):
    """Batches of five in the order of keys, for each series."""
    rank = F.row_number().over(Window.partitionBy("series").orderBy("o_orderkey"))
    return m.settled.select("o_orderkey", F.floor((rank - 1) / 5).alias("batch"))


@query("SELECT o_orderpriority AS status, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE settled_us >= 883612800000000) AS BIGINT) AS current, CAST(count(*) FILTER (WHERE settled_us < 883612800000000) AS BIGINT) AS superseded, CAST(count(*) FILTER (WHERE o_totalprice > 50000 AND settled_us >= 883612800000000) AS BIGINT) AS with_oi FROM settled GROUP BY ALL", "settled")
def q09_discovery_status(m):
    now = F.col("settled_us") >= 883612800000000
    return m.settled.groupBy(F.col("o_orderpriority").alias("status")).agg(F.count("*").alias("n"), *_n(("current", now), ("superseded", ~now), ("with_oi", now & (F.col("o_totalprice") > 50000))))


@query("SELECT * FROM (SELECT series, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE result IS NULL) AS BIGINT) AS open, CAST(count(*) FILTER (WHERE o_totalprice > 1000) AS BIGINT) AS traded FROM settled GROUP BY series) QUALIFY row_number() OVER (ORDER BY n DESC, series) <= 10", "settled")
def q10_settled_status(m):
    """The ten largest categories of a report."""
    by = m.settled.groupBy("series").agg(F.count("*").alias("n"), *_n(("open", F.col("result").isNull()), ("traded", F.col("o_totalprice") > 1000)))
    return by.orderBy(F.col("n").desc(), "series").limit(10)


@query("SELECT 'snapshots' AS dataset, CAST(count(*) AS BIGINT) AS n, min(period_us) AS first, max(period_us) AS last, count(DISTINCT ticker) AS tickers FROM candles UNION ALL SELECT 'trades', CAST(count(*) AS BIGINT), min(ts_us), max(ts_us), count(DISTINCT ticker) FROM tape", "candles", "tape")
def q11_snapshot_and_trade_status(m):
    def of(df, name, at):
        return df.agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.count_distinct("ticker").alias("tickers")).select(F.lit(name).alias("dataset"), "*")

    return of(m.candles, "snapshots", "period_us").unionByName(of(m.tape, "trades", "ts_us"))


@query("SELECT p.*, CAST(l.options AS BIGINT) AS options, CAST(l.expiries AS BIGINT) AS expiries FROM (SELECT l_suppkey AS symbol, CAST(count(*) AS BIGINT) AS n, epoch_us(min(l_shipdate)) AS first, epoch_us(max(l_shipdate)) AS last, round(avg(l_quantity), 6) AS spot FROM lineitem GROUP BY ALL) p JOIN (SELECT l_suppkey, count(*) AS options, count(DISTINCT l_partkey) AS expiries FROM (SELECT *, max(l_shipdate) OVER (PARTITION BY l_suppkey) AS top FROM lineitem) WHERE l_shipdate = top GROUP BY ALL) l ON symbol = l_suppkey")
def q12_options_status(m):
    """Each symbol's totals, and options and expiries of its latest snapshot: rows that a part of the table already shows to be older go before the shuffle, and a second aggregation meets the first by symbol and time."""
    rows = m.raw("lineitem").select(F.col("l_suppkey").alias("symbol"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"), "l_quantity", "l_partkey")
    whole = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.round(F.avg("l_quantity"), 6).alias("spot"))
    latest = rows.select("symbol", "at", "l_partkey").withColumn("_rank", F.rank().over(Window.partitionBy("symbol").orderBy(F.col("at").desc()))).where("_rank = 1")
    each = latest.groupBy("symbol", "at").agg(F.count("*").alias("options"), F.count_distinct("l_partkey").alias("expiries"))
    return whole.join(each.withColumnRenamed("at", "last"), ["symbol", "last"])


@query("SELECT n_nationkey AS id, CAST(count(s_suppkey) AS BIGINT) AS observations, CAST(min(s_suppkey) AS BIGINT) AS first, CAST(max(s_suppkey) AS BIGINT) AS last FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def q13_series_status(m):
    """All series, those without an observation too."""
    joined = m.raw("nation").join(m.raw("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy(F.col("n_nationkey").alias("id")).agg(F.count("s_suppkey").alias("observations"), F.min("s_suppkey").alias("first"), F.max("s_suppkey").alias("last"))


@query("SELECT event_type AS exchange, count(DISTINCT ts_us // 86400000000) AS days, CAST(sum(count) AS BIGINT) AS records, min(ts_us) AS first, max(ts_us) AS last FROM tape GROUP BY ALL", "tape")
def q15_archive_status(m):
    day = F.floor(F.col("ts_us") / DAY)
    return m.tape.groupBy(F.col("event_type").alias("exchange")).agg(F.count_distinct(day).alias("days"), F.sum("count").cast("bigint").alias("records"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))


@query("WITH d AS (SELECT event_type, ts_us // 86400000000 AS day, CAST(count(*) AS BIGINT) AS records FROM tape WHERE yes_cents > 50 GROUP BY ALL), g AS (SELECT event_type, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY event_type) SELECT g.event_type, g.day, coalesce(d.records, 0) AS records FROM g LEFT JOIN d ON g.event_type = d.event_type AND g.day = d.day", "tape")
def q16_archive_log(m):
    """A log row for each day, those without records too."""
    have = m.tape.where("yes_cents > 50").groupBy("event_type", F.floor(F.col("ts_us") / DAY).alias("day")).agg(F.count("*").alias("records"))
    every = have.groupBy("event_type").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return every.join(have, ["event_type", "day"], "left").select("event_type", "day", F.coalesce("records", F.lit(0)).alias("records"))


@query(f"SELECT ticker, settled_us >= {END} - 365 * {DAY} AS active FROM settled", "settled")
def q17_active_flags(m):
    """Markets that have ended lose their flag."""
    return m.settled.select("ticker", F.when(F.col("settled_us") < END - 365 * DAY, False).otherwise(True).alias("active"))


@query("SELECT vec_id, i - 1 AS i, v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def q19_parallel_arrays(m):
    """Parallel arrays become rows by place."""
    return m.raw("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), "v")


@query("SELECT ticker, last_volume FROM (SELECT ticker, arg_max(volume, (period_us, seq)) AS last_volume FROM candles GROUP BY ticker) WHERE last_volume > 0", "candles")
def q21_active_markets(m):
    last = m.candles.groupBy("ticker").agg(F.max_by("volume", F.struct("period_us", "seq")).alias("last_volume"))
    return last.where("last_volume > 0")


@query("SELECT dataset, n, n > 5000 AS guarded, CASE WHEN n > 5000 THEN 4 ELSE 1 END AS every FROM (SELECT 'candles' AS dataset, CAST(count(*) AS BIGINT) AS n FROM candles UNION ALL SELECT 'tape', CAST(count(*) AS BIGINT) FROM tape)", "candles", "tape")
def q22_size_guard(m):
    """Datasets over a size are polled less often."""
    sizes = m.candles.agg(F.count("*").alias("n")).select(F.lit("candles").alias("dataset"), "n").unionByName(m.tape.agg(F.count("*").alias("n")).select(F.lit("tape").alias("dataset"), "n"))
    return sizes.select("dataset", "n", (F.col("n") > 5000).alias("guarded"), F.when(F.col("n") > 5000, 4).otherwise(1).alias("every"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 - 1 END <> 0, true) AS flag, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q23_migrated(m):
    """Integers become booleans, a missing one true; a surrogate key becomes the natural one by a join."""
    flag = F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3 - 1)
    return m.raw("customer").join(m.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.coalesce(flag.cast("boolean"), F.lit(True)).alias("flag"), F.col("n_name").alias("nation"))


@query("SELECT k, v FROM (SELECT o_orderkey AS k, 1 AS v FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 3 <> 0)")
def q24_copied(m):
    """Rows of another table whose key isn't there yet."""
    keys = m.raw("orders").select(F.col("o_orderkey").alias("k"))
    old = keys.where("k % 3 = 0").withColumn("v", F.lit(1))
    return old.unionByName(K.insert_new(old, keys.withColumn("v", F.lit(2)), ["k"]))


@query("SELECT trade_id FROM tape t JOIN (SELECT ticker, max(ts_us) AS cutoff FROM tape WHERE trade_id % 2 = 0 GROUP BY ticker) c ON t.ticker = c.ticker WHERE t.ts_us > c.cutoff", "tape")
def q25_gap_copy(m):
    """What came after the last row that the target has of a key."""
    cutoff = m.tape.where("trade_id % 2 = 0").groupBy("ticker").agg(F.max("ts_us").alias("cutoff"))
    return m.tape.join(cutoff, "ticker").where("ts_us > cutoff").select("trade_id")


@query("SELECT ticker FROM settled WHERE o_totalprice >= 500 * 100 AND event_ticker NOT IN (SELECT event_ticker FROM settled WHERE o_orderkey % 97 = 0)", "settled")
def q26_downloads(m):
    """Markets of enough volume, without those of events that are stored."""
    stored = m.settled.where("o_orderkey % 97 = 0").select("event_ticker").distinct()
    return m.settled.where(F.col("o_totalprice") >= 500 * 100).join(stored, "event_ticker", "left_anti").select("ticker")


@query("SELECT event_ticker, list_aggregate(list(CAST(o_orderkey AS VARCHAR) ORDER BY strike DESC, o_orderkey), 'string_agg', ',') AS chain FROM (SELECT *, floor(o_totalprice / 1000) AS strike FROM settled) GROUP BY event_ticker", "settled")
def q29_chains(m):
    """Chains of an event in the order of strikes; an event has few markets."""
    strike = F.struct((-F.floor(F.col("o_totalprice") / 1000)).alias("s"), F.col("o_orderkey").alias("k"))
    by = m.settled.groupBy("event_ticker").agg(F.array_sort(F.collect_list(strike)).alias("c"))
    return by.select("event_ticker", F.array_join(F.transform("c", lambda x: x["k"].cast("string")), ",").alias("chain"))


@query("SELECT trade_id FROM tape WHERE ts_us BETWEEN 1704500000000000 AND 1705000000000000", "tape")
def q40_bounded_tape(m):
    return m.tape.where(F.col("ts_us").between(1704500000000000, 1705000000000000)).select("trade_id")


@query("SELECT CAST(p AS INTEGER) AS price, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(won AS INTEGER)) * 100 - p, 6) AS edge FROM (SELECT (mid2 // 20) * 10 AS p, yes AS won FROM observations) GROUP BY p", "observations")
def q44_edges_by_price(m):
    by = m.observations.groupBy((F.floor(F.col("mid2") / 20) * 10).cast("int").alias("price")).agg(F.count("*").alias("n"), F.avg(F.col("yes").cast("int")).alias("won"))
    return by.select("price", "n", F.round(F.col("won") * 100 - F.col("price"), 6).alias("edge"))


@query("SELECT trade_id AS order_id, CAST(count AS BIGINT) AS queue_position FROM tape WHERE trade_id % 10 <> 0 AND count > 1", "tape")
def q50_queue_positions(m):
    """Items without an order or a place are left out."""
    items = m.tape.select(F.when(F.col("trade_id") % 10 != 0, F.struct(F.col("trade_id").alias("order_id"), F.when(F.col("count") > 1, F.col("count").cast("bigint")).alias("queue_position"))).alias("i"))
    return items.where("i.order_id IS NOT NULL AND i.queue_position IS NOT NULL").select("i.*")


def _checks_sql(table, rules):
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, CAST(count(*) FILTER (WHERE ({among}) AND coalesce({bad}, false)) AS BIGINT) AS bad, CAST(count(*) FILTER (WHERE {among}) AS BIGINT) AS total, count(*) FILTER (WHERE ({among}) AND coalesce({bad}, false)) <= greatest({number}, {share} * count(*) FILTER (WHERE {among})) AS passed FROM {table}" for n, (bad, among, share, number) in rules.items())


def _checks(df, rules):
    return H.checks(df, {n: (F.expr(bad), F.expr(among), share, number) for n, (bad, among, share, number) in rules.items()})


RULES = {
    "h05": {"null_structure": ("nullif(o_orderpriority, '3-MEDIUM') IS NULL", "true", 0.05, 0), "null_result": ("result IS NULL", "true", 0.05, 0)},
    "h06": {"no_close_time": ("settled_us IS NULL", "true", 0, 0), "no_volume": ("o_totalprice <= 1000", "true", 0.5, 0), "stale": (f"settled_us < {END} - 30 * {DAY}", "result IS NULL", 0, 100)},
    "h07": {"no_result": ("result IS NULL", "true", 0.01, 0), "no_settled_at": ("settled_us IS NULL", "true", 0.01, 0)},
    "h08": {"inverted": ("ask < bid", f"period_us >= {END} - 7 * {DAY}", 0, 0), "missing_quote": ("bid IS NULL OR ask IS NULL", "true", 0, 0)},
    "h09": {"negative_price": ("yes_cents < 0", "true", 0, 0), "no_count": ("count <= 0", "true", 0, 0)},
}


def _least_sql(table, rules, time=""):
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, CAST(greatest(0, {least} - value) AS BIGINT) AS bad, CAST(value AS BIGINT) AS total, value >= {least} AS passed FROM (SELECT coalesce({of.format(at=f'make_timestamp({time})')}, 0) AS value FROM {table})" for n, (of, least) in rules.items())


def _least(df, rules, time=""):
    return H.at_least(df, {n: (F.expr(of.format(at=f"timestamp_micros({time})")), least) for n, (of, least) in rules.items()})


MONTH = "(year({at}) * 12 + month({at}))"
#: A value and what it must be at least; months: those with rows less those from the first to the last.
LEAST = {
    "h05": {"categories": ("count(DISTINCT CASE WHEN result IS NOT NULL THEN o_orderpriority END)", 3)},
    "h08": {"last_hour": (f"count_if(period_us > {END} - 3600000000 AND period_us <= {END})", 1), "last_day": (f"count_if(period_us > {END} - {DAY} AND period_us <= {END})", 1)},
    "h09": {"last_day": (f"count_if(ts_us > {END} - {DAY})", 1), "months": (f"count(DISTINCT {MONTH}) - (max({MONTH}) - min({MONTH}) + 1)", 0)},
}
EVENTS_SQL = "(SELECT event_ticker, count(result) AS n, min(nullif(o_orderpriority, '3-MEDIUM')) AS structure FROM settled GROUP BY event_ticker)"
EVENT_RULES = {"no_markets": ("n = 0", "true", 0.05, 0), "event_structure": ("structure IS NULL", "true", 0.10, 0)}


@query(_checks_sql("settled", RULES["h05"]) + " UNION ALL " + _least_sql("settled", LEAST["h05"]), "settled")
def h05_event_checks(m):
    return _checks(m.settled, RULES["h05"]).unionByName(_least(m.settled, LEAST["h05"]))


@query(_checks_sql("settled", RULES["h06"]), "settled")
def h06_market_checks(m):
    return _checks(m.settled, RULES["h06"])


@query(_checks_sql("settled", RULES["h07"]) + " UNION ALL " + _checks_sql(EVENTS_SQL, EVENT_RULES), "settled")
def h07_settlement_checks(m):
    events = m.settled.groupBy("event_ticker").agg(F.count("result").alias("n"), F.min(F.nullif("o_orderpriority", F.lit("3-MEDIUM"))).alias("structure"))
    return _checks(m.settled, RULES["h07"]).unionByName(_checks(events, EVENT_RULES))


@query(_checks_sql("candles", RULES["h08"]) + " UNION ALL " + _least_sql("candles", LEAST["h08"]), "candles")
def h08_snapshot_checks(m):
    return _checks(m.candles, RULES["h08"]).unionByName(_least(m.candles, LEAST["h08"]))


@query(_checks_sql("tape", RULES["h09"]) + " UNION ALL " + _least_sql("tape", LEAST["h09"], "ts_us"), "tape")
def h09_trade_checks(m):
    return _checks(m.tape, RULES["h09"]).unionByName(_least(m.tape, LEAST["h09"], "ts_us"))


@query("SELECT series AS dataset_id, min(period_us) AS first, max(period_us) AS last, CAST(count(*) AS BIGINT) AS n FROM observations WHERE bid > 20 GROUP BY series", "observations")
def h02_cache_refresh(m):
    """First and last time and rows of each dataset, of those that pass its filter."""
    return m.observations.where("bid > 20").groupBy(F.col("series").alias("dataset_id")).agg(F.min("period_us").alias("first"), F.max("period_us").alias("last"), F.count("*").alias("n"))


@query("SELECT min(ts_us) AS first, max(ts_us) AS last, CAST(count(*) AS BIGINT) AS n FROM tape WHERE taker_side = 'yes'", "tape")
def a28_freshness(m):
    return H.freshness(m.tape, "ts_us", F.col("taker_side") == "yes")


@query("SELECT coalesce(nullif(CASE WHEN trade_id % 3 = 0 THEN event_type ELSE '' END, ''), 'unknown') AS process, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE pnl > 0) AS BIGINT) AS wins, CAST(sum(pnl) AS BIGINT) AS total FROM (SELECT *, CASE WHEN trade_id % 2 = 0 THEN 100 - yes_cents ELSE -yes_cents END AS pnl FROM tape) GROUP BY ALL", "tape")
def a21_by_process(m):
    pnl = F.when(F.col("trade_id") % 2 == 0, 100 - F.col("yes_cents")).otherwise(-F.col("yes_cents"))
    named = F.coalesce(F.nullif(F.when(F.col("trade_id") % 3 == 0, F.col("event_type")).otherwise(""), F.lit("")), F.lit("unknown"))
    return T.summary(m.tape.select(named.alias("process"), pnl.alias("pnl")), ["process"]).select("process", "n", "wins", "total")


@query("SELECT gp, least(9, CAST(floor(mid * 10) AS INTEGER)) AS stratum, CAST(count(*) AS BIGINT) AS n, round(avg(mid), 6) AS predicted, round(avg(CAST(yes AS INTEGER)), 6) AS observed, round(abs(avg(mid) - avg(CAST(yes AS INTEGER))), 6) AS gap FROM observations GROUP BY ALL", "observations")
def a24_stratified(m):
    by = m.observations.groupBy("gp", F.least(F.lit(9), F.floor(F.col("mid") * 10).cast("int")).alias("stratum"))
    out = by.agg(F.count("*").alias("n"), F.avg("mid").alias("p"), F.avg(F.col("yes").cast("int")).alias("o"))
    return out.select("gp", "stratum", "n", F.round("p", 6).alias("predicted"), F.round("o", 6).alias("observed"), F.round(F.abs(F.col("p") - F.col("o")), 6).alias("gap"))


@query("SELECT event_type, round(sum(yes_cents * count * greatest(trade_id % 9 / 4.0::DOUBLE, 1.0)), 6) AS capital_days, CAST(sum(pnl) AS BIGINT) AS pnl, round(sum(pnl) * 365 / sum(yes_cents * count * greatest(trade_id % 9 / 4.0::DOUBLE, 1.0)), 6) AS annualized FROM (SELECT *, (CASE WHEN trade_id % 2 = 0 THEN 100 - yes_cents ELSE -yes_cents END) * count AS pnl FROM tape) GROUP BY ALL", "tape")
def a31_trade_report(m):
    """Capital-days with a day at least, and what a year of them would return."""
    pnl = F.when(F.col("trade_id") % 2 == 0, 100 - F.col("yes_cents")).otherwise(-F.col("yes_cents")) * F.col("count")
    used = X.capital_days(F.col("yes_cents"), F.col("count"), (F.col("trade_id") % 9) / F.lit(4.0))
    by = m.tape.groupBy("event_type").agg(F.sum(used).alias("c"), F.sum(pnl).alias("p"))
    return by.select("event_type", F.round("c", 6).alias("capital_days"), F.col("p").cast("bigint").alias("pnl"), F.round(F.col("p") * 365 / F.col("c"), 6).alias("annualized"))


@query("SELECT ticker, round(avg(CASE WHEN count >= 1 THEN 1 ELSE 0 END), 9) AS p1, round(avg(CASE WHEN count >= 10 THEN 1 ELSE 0 END), 9) AS p10, round(avg(CASE WHEN count >= 50 THEN 1 ELSE 0 END), 9) AS p50 FROM tape GROUP BY ticker", "tape")
def a18_exceedance(m):
    return m.tape.groupBy("ticker").agg(*[F.round(F.count_if(F.col("count") >= t) / F.count("*"), 9).alias(f"p{t}") for t in (1, 10, 50)])


@query("SELECT o.trade_id AS order_id, CAST(coalesce(sum(t.count), 0) AS BIGINT) AS volume FROM tape o LEFT JOIN tape t ON o.ticker = t.ticker AND t.ts_us BETWEEN o.ts_us - 86400000000 AND o.ts_us GROUP BY o.trade_id", "tape")
def w06_trailing_both_ends(m):
    at = m.tape.select(F.col("trade_id").alias("order_id"), "ticker", F.col("ts_us").alias("at_us"))
    return W.trailing_volume(m.tape, at, both_ends=True).select("order_id", F.col("volume").cast("bigint").alias("volume"))


@query("SELECT o.trade_id AS order_id, CAST(least(30, coalesce(sum(t.count) FILTER (WHERE t.taker_side = 'no' AND t.yes_cents <= 90), 0)) AS BIGINT) AS filled FROM tape o LEFT JOIN tape t ON o.ticker = t.ticker AND t.ts_us > o.ts_us AND t.ts_us < o.ts_us + 864000000000 GROUP BY o.trade_id", "tape")
def m04_tape_fills(m):
    """Fills strictly between placement and end, without a queue."""
    orders = m.tape.select(F.col("trade_id").alias("order_id"), "ticker", F.lit("yes").alias("side"), F.lit(90).alias("limit"), F.lit(30).alias("quantity"), F.col("ts_us").alias("from_us"), (F.col("ts_us") + 864_000_000_000).alias("to_us"))
    return W.flow_between(orders, m.tape).select("order_id", F.least(F.lit(30).cast("bigint"), F.col("flow")).alias("filled"))


@query("SELECT series, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(won AS INTEGER)) * 100 - avg(mid), 6) AS edge FROM (SELECT series, CASE WHEN mid2 // 2 BETWEEN 85 AND 97 THEN mid2 // 2 ELSE (200 - mid2) // 2 END AS mid, CASE WHEN mid2 // 2 BETWEEN 85 AND 97 THEN yes ELSE NOT yes END AS won FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_us DESC, seq DESC) AS rn FROM observations) WHERE rn = 1 AND (mid2 // 2 BETWEEN 85 AND 97 OR (200 - mid2) // 2 BETWEEN 85 AND 97)) GROUP BY series HAVING count(*) >= 2", "observations")
def c05_snapshot_edges(m):
    """The last snapshot of a market, if it is a tail of either side."""
    last = J.first_of(m.observations, ["ticker"], F.col("period_us").desc(), F.col("seq").desc())
    tails = last.select("series", "yes", F.explode(X.tails(F.col("bid"), F.col("ask"))).alias("t"))
    rows = tails.select("series", F.col("t.mid").alias("mid"), F.when(F.col("t.side") == "yes", F.col("yes")).otherwise(~F.col("yes")).alias("won"))
    return C.series_edges(rows, 2).select("series", "n", F.round("edge", 6).alias("edge"))


FEE1 = "CAST(ceil(round(0.0175 * 5 * (entry / 100.0) * (1 - entry / 100.0) * 100, 9)) AS INTEGER)"


@query(
    f"""SELECT ticker, side, CAST(entry AS INTEGER) AS entry, CAST((CASE WHEN won THEN 100 - entry ELSE -entry END) * 5 - {FEE1} AS BIGINT) AS pnl FROM (SELECT *, yes = (side = 'yes') AS won, row_number() OVER (PARTITION BY ticker ORDER BY period_us, seq) AS rn FROM (
    SELECT o.*, CASE WHEN mid2 // 2 BETWEEN 85 AND 97 THEN 'yes' ELSE 'no' END AS side, CASE WHEN mid2 // 2 BETWEEN 85 AND 97 THEN mid2 // 2 ELSE (200 - mid2) // 2 END AS entry FROM observations o JOIN (SELECT series, avg(CAST(yes AS INTEGER)) - avg(mid) AS edge FROM observations GROUP BY series HAVING count(*) >= 5) e ON o.series = e.series
    WHERE abs(e.edge) >= 0.01 AND hours BETWEEN 0 AND 60 * 24) WHERE entry BETWEEN 85 AND 97 AND (side = 'yes' AND ask <= entry OR side = 'no' AND 100 - bid <= entry)) WHERE rn = 1""",
    "observations",
)
def m11_backtest_with_edges(m):
    """Of each market the first tail whose series has an edge, within the window of entry, that its own candle reaches, bought at the mid."""
    edges = m.observations.groupBy("series").agg((F.avg(F.col("yes").cast("int")) - F.avg("mid")).alias("edge"), F.count("*").alias("n")).where("n >= 5 AND abs(edge) >= 0.01").select("series")
    rows = m.observations.where(F.col("hours").between(0, 60 * 24)).join(edges, "series", "left_semi")
    tails = rows.select("ticker", "period_us", "seq", "bid", "ask", "result", F.explode(X.tails(F.col("bid"), F.col("ask"))).alias("t")).select("*", "t.*")
    none = F.lit(None).cast("int")
    hit = tails.where(X.touched(F.col("side"), F.col("mid"), F.col("bid"), F.col("ask"), none, none))
    first = J.first_of(hit, ["ticker"], F.col("period_us"), F.col("seq"))
    exit_ = F.when(F.col("result") == F.col("side"), 100).otherwise(0)
    return first.select("ticker", "side", F.col("mid").cast("int").alias("entry"), X.pnl(F.col("mid"), exit_, F.lit(5), X.fee(F.col("mid"), F.lit(5))).cast("bigint").alias("pnl"))


JOINT = [("yes", 90, 1, 0.3, 0.5), ("yes", 90, 4, 0.2, 0.4), ("yes", 95, 5, 0.1, 0.3), ("no", 86, 2, 0.6, 0.2), ("no", 97, 3, 0.5, 0.5)]


@query(
    f"""WITH f AS (SELECT * FROM (VALUES {', '.join(str(r) for r in JOINT)}) v(side, lim, quantity, p_won, p_lost)),
    m AS (SELECT ticker, event_ticker, (o_orderkey % 100) / 100.0::DOUBLE AS p FROM settled),
    g AS (SELECT *, CASE WHEN side = 'no' THEN 1 - p ELSE p END AS q, CAST(ceil(round(0.0175 * quantity * (lim / 100.0) * (1 - lim / 100.0) * 100, 9)) AS INTEGER) / CAST(quantity AS DOUBLE) AS fee FROM m, f WHERE lim * quantity <= 400),
    e AS (SELECT *, round((q * CAST(p_won AS DOUBLE) * (100 - lim - fee) - (1 - q) * CAST(p_lost AS DOUBLE) * (lim + fee)) * quantity, 9) AS total FROM g)
    SELECT event_ticker, ticker, side, lim, quantity, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY event_ticker ORDER BY total DESC, ticker, side = 'no', lim, quantity) AS rn FROM e WHERE total > 0) WHERE rn = 1""",
    "settled",
)
def r02_joint_scan(m):
    """Side, limit and quantity at once, within the budget; one set of rates for all markets here."""
    markets = m.settled.select("ticker", "event_ticker", ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("p_event"), F.lit("g").alias("gp"), F.lit("t").alias("topic"))
    rates = m.spark.createDataFrame([("g", "t", *r) for r in JOINT], "gp string, topic string, side string, limit int, quantity int, p_won double, p_lost double")
    return S.joint_scan(markets, rates).select("event_ticker", "ticker", "side", F.col("limit").alias("lim"), "quantity", F.round("total_ev", 6).alias("total"))


@query(
    """SELECT user_id, event_id, n = 20 AND capture < 0.25 AS paused FROM (SELECT user_id, event_id, count(*) OVER w AS n, (avg(CASE WHEN event_id % 10 < 9 THEN 1 ELSE 0 END) OVER w - 0.85) / avg(0.01 + (event_id % 7) / 100.0::DOUBLE) OVER w AS capture FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
)
def r06_alpha_decay(m):
    e = F.col("event_id")
    trades = m.raw("events").select("user_id", e.alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("settled_us"), (0.01 + (e % 7) / F.lit(100.0)).alias("edge"), (e % 10 < 9).alias("won"))
    return T.decayed(trades, ["user_id"], window=20).select("user_id", F.col("id").alias("event_id"), "paused")


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber % 2 AS l, l_partkey AS v, l_suppkey * 1000000 + l_partkey AS w, l_returnflag <> 'N' AS historical, l_partkey % 2 AS batch FROM lineitem),
stored AS (SELECT * FROM r WHERE batch = 0 QUALIFY row_number() OVER (PARTITION BY k, l ORDER BY historical DESC, w DESC) = 1)
SELECT k, l, v FROM (SELECT * FROM stored UNION ALL SELECT * FROM r WHERE batch = 1) QUALIFY row_number() OVER (PARTITION BY k, l ORDER BY historical DESC, batch, w DESC) = 1""")
def k02_last_of_batch(m):
    """Two batches in which keys repeat: the last of a batch counts, then the splice into what is stored."""
    rows = m.raw("lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 2).alias("l"), F.col("l_partkey").alias("v"), (F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).alias("at"), F.when(F.col("l_returnflag") == "N", "live").otherwise("historical").alias("origin"))
    last = F.col("at").desc()
    stored = K.splice(rows.limit(0), rows.where("v % 2 = 0"), ["k", "l"], "origin", last)
    return K.splice(stored, rows.where("v % 2 = 1"), ["k", "l"], "origin", last).select("k", "l", "v")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'stored' ELSE 'live' END AS origin FROM orders")
def k03_live_insert(m):
    """Live rows never replace what is there."""
    keys = m.raw("orders").select(F.col("o_orderkey").alias("k"))
    old = keys.where("k % 2 = 0").withColumn("origin", F.lit("stored"))
    return old.unionByName(K.insert_new(old, keys.withColumn("origin", F.lit("live")), ["k"]))
