"""Health, registry, status, retention, and streams replayed from files."""

import uuid

from pyspark.sql import functions as F

from tidemark.operators import health as H
from tidemark.operators import sinks as K
from tidemark.plans.catalog import query
from tidemark.session import shared_folder
from tidemark.streaming import streams as ST

END = 904608000000000  # 1998-09-01


@query(
    f"""SELECT series AS dataset_id, CASE WHEN series = 'S3' THEN 'backfill_only' WHEN max(period_us) FILTER (WHERE bid > 20) IS NULL THEN 'no_data' WHEN series LIKE '%5' THEN 'last_run_failed' WHEN {END} - max(period_us) FILTER (WHERE bid > 20) > 200000000000 THEN 'stale' ELSE 'healthy' END AS status FROM (SELECT split_part(ticker, '-', 1) AS series, * FROM candles WHERE period_us < {END}) GROUP BY series""",
    "candles",
)
def h01_health_status(m):
    rows = m.candles.where(F.col("period_us") < END).withColumn("series", F.split_part("ticker", F.lit("-"), F.lit(1)))
    sets = rows.groupBy(F.col("series").alias("dataset_id")).agg(F.max(F.when(F.col("bid") > 20, F.col("period_us"))).alias("freshest_us"))
    full = sets.withColumn("provenance", F.when(F.col("dataset_id") == "S3", "backfill_only")).withColumn("last_status", F.when(F.col("dataset_id").like("%5"), "failed").otherwise("completed")).withColumn("max_stale_us", F.lit(200_000_000_000))
    return H.status(full, F.lit(END)).select("dataset_id", "status")


@query(
    """SELECT 'negative_bid' AS check_name, CAST(count(*) FILTER (WHERE bid < 0) AS BIGINT) AS bad, CAST(count(*) AS BIGINT) AS total, count(*) FILTER (WHERE bid < 0) <= 0 AS passed FROM candles
    UNION ALL SELECT 'crossed', CAST(count(*) FILTER (WHERE ask < bid) AS BIGINT), CAST(count(*) AS BIGINT), count(*) FILTER (WHERE ask < bid) <= 0 FROM candles
    UNION ALL SELECT 'over_100', CAST(count(*) FILTER (WHERE ask > 100 AND volume > 10) AS BIGINT), CAST(count(*) FILTER (WHERE volume > 10) AS BIGINT), count(*) FILTER (WHERE ask > 100 AND volume > 10) <= 0.05 * count(*) FILTER (WHERE volume > 10) FROM candles""",
    "candles",
)
def h04_candle_checks(m):
    every = F.lit(True)
    return H.checks(m.candles, {"negative_bid": (F.col("bid") < 0, every, 0, 0), "crossed": (F.col("ask") < F.col("bid"), every, 0, 0), "over_100": (F.col("ask") > 100, F.col("volume") > 10, 0.05, 0)})


@query("WITH h AS (SELECT DISTINCT ticker, CAST(floor(ts_us / 3600000000) AS BIGINT) AS hour FROM tape) SELECT s.ticker, CAST(g.hour AS BIGINT) AS hour FROM (SELECT ticker, min(hour) AS a, max(hour) AS b FROM h GROUP BY ticker) s, LATERAL (SELECT unnest(range(s.a, s.b + 1)) AS hour) g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.ticker = s.ticker AND h.hour = g.hour)", "tape")
def h10_hourly_gaps(m):
    return H.hourly_gaps(m.tape, "ticker", "ts_us")


@query(f"SELECT ticker, period_us, seq FROM candles WHERE period_us >= {END} - 90 * 86400000000 AND NOT (bid < 10)", "candles")
def k13_retention(m):
    return K.without_old(m.candles, "period_us", END, 90, F.col("bid") < 10).select("ticker", "period_us", "seq")


@query(f"SELECT ticker, period_us, seq, CASE WHEN period_us >= {END} - 60 * 86400000000 THEN volume END AS volume FROM candles", "candles")
def k14_column_retention(m):
    return K.without_columns(m.candles, "period_us", END, 60, ["volume"]).select("ticker", "period_us", "seq", "volume")


@query("SELECT 'result' AS grouped_by, coalesce(result, 'null') AS value, CAST(count(*) AS BIGINT) AS n FROM settled GROUP BY ALL UNION ALL SELECT 'series', series, CAST(count(*) AS BIGINT) FROM settled GROUP BY ALL UNION ALL SELECT 'result,series', coalesce(result, 'null') || ',' || series, CAST(count(*) AS BIGINT) FROM settled GROUP BY ALL", "settled")
def q01_counts(m):
    return H.counts_by(m.settled, [["result"], ["series"], ["result", "series"]])


@query("SELECT origin, CAST(count(*) AS BIGINT) AS n, min(period_us) AS first, max(period_us) AS last, count(DISTINCT ticker) AS tickers FROM candles GROUP BY origin", "candles")
def q08_candle_status(m):
    return m.candles.groupBy("origin").agg(F.count("*").alias("n"), F.min("period_us").alias("first"), F.max("period_us").alias("last"), F.count_distinct("ticker").alias("tickers"))


@query("SELECT series, list_aggregate(list(ticker ORDER BY o_totalprice DESC, ticker)[:5], 'string_agg', ',') AS top FROM settled GROUP BY series", "settled")
def q05_top_markets(m):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("series").orderBy(F.col("o_totalprice").desc(), "ticker"))
    top = m.settled.withColumn("rank", rank).where("rank <= 5")
    return top.groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker"))), lambda x: x["ticker"]), ",").alias("top"))


@query("SELECT count(DISTINCT ticker) AS tickers, CAST(count(*) FILTER (WHERE ts_us < 1705000000000000) AS BIGINT) AS ended, CAST(count(*) FILTER (WHERE ts_us >= 1705000000000000) AS BIGINT) AS active FROM tape", "tape")
def q14_ended_and_active(m):
    ended = F.col("ts_us") < 1705000000000000
    return m.tape.agg(F.count_distinct("ticker").alias("tickers"), F.count_if(ended).alias("ended"), F.count_if(~ended).alias("active"))


@query("SELECT CAST(count(*) FILTER (WHERE period_us < 883612800000000) AS BIGINT) AS old, CAST(count(*) AS BIGINT) AS n FROM candles", "candles")
def q27_retention_dry_run(m):
    return m.candles.agg(F.count_if(F.col("period_us") < 883612800000000).alias("old"), F.count("*").alias("n"))


@query("SELECT ticker, max(ts_us) AS last_us, CAST(count(*) AS BIGINT) AS n FROM tape GROUP BY ticker", "tape")
def q18_incremental_start(m):
    return m.tape.groupBy("ticker").agg(F.max("ts_us").alias("last_us"), F.count("*").alias("n"))


def _stream(m):
    files = m.spark.read.parquet(f"{m.sf_dir}/events.parquet")
    events = m.spark.readStream.schema(files.schema).option("pathGlobFilter", "*.parquet").parquet(f"{m.sf_dir}/events*.parquet")
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def _in_files(m, rows_a_file=5_000_000):
    """The events, ranges of their ids dealt out to three files at least, of which a micro-batch takes one. Files are taken by age, so they are written one after the other."""
    path = f"{shared_folder(m.spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    events = m.raw("events")
    rows, low, high = events.agg(F.count("*"), F.min("event_id"), F.max("event_id")).first()
    files = max(3, -(-rows // rows_a_file))
    for i in range(files if rows else 0):
        a, b = (low + (high + 1 - low) * k // files for k in (i, i + 1))
        events.where(F.col("event_id") >= a).where(F.col("event_id") < b).coalesce(1).write.mode("append").parquet(path)
    if not rows:
        events.write.parquet(path)
    return ST.files(m.spark, path, events.schema, 1)


@query("SELECT user_id, CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS start_us, arg_min(v, (ts, v)) AS open, max(v) AS high, min(v) AS low, arg_max(v, (ts, v)) AS close, CAST(count(*) AS BIGINT) AS volume FROM (SELECT user_id, ts, CAST(floor(value * 100) AS BIGINT) AS v FROM events) GROUP BY ALL")
def st07_candles_from_tape(m):
    stream = _stream(m).withColumn("v", F.floor(F.col("value") * 100)).withColumn("one", F.lit(1))
    out = ST.run_once(ST.ohlc(stream, "at", "user_id", "v", "one"), f"ohlc_{uuid.uuid4().hex}", "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "open", "high", "low", "close", "volume")


@query("SELECT user_id, CAST(epoch_us(date_trunc('hour', ts)) - 3600000000 * g.i AS BIGINT) AS start_us, CAST(count(*) AS BIGINT) AS volume FROM events, range(0, 24) g(i) GROUP BY ALL")
def st08_sliding_volume(m):
    out = ST.run_once(ST.sliding_volume(_stream(m).withColumn("one", F.lit(1)), "at", "user_id", "one"), f"sliding_{uuid.uuid4().hex}", "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "volume")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, session")
def st09_sessions(m):
    out = ST.run_once(ST.sessions(_stream(m), "at", "user_id"), f"sessions_{uuid.uuid4().hex}", "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT event_id, user_id FROM events")
def st04_once_by_key(m):
    doubled = _stream(m).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return ST.run_once(ST.once_by_key(doubled, "event_id", "at"), f"once_{uuid.uuid4().hex}").select("event_id", "user_id")


@query("SELECT user_id AS key, CAST(count(*) AS BIGINT) AS n, CAST(arg_max(cum, event_id) AS BIGINT) AS cum, CAST(greatest(0, max(cum)) AS BIGINT) AS peak, CAST(greatest(0, max(cum)) - arg_max(cum, event_id) AS BIGINT) AS drawdown FROM (SELECT user_id, event_id, sum(CAST(floor(value) AS BIGINT) % 21 - 10) OVER (PARTITION BY user_id ORDER BY event_id) AS cum FROM events) GROUP BY user_id")
def st11_running_drawdown(m):
    """Over several files, one a micro-batch; a key's last row counts."""
    rows = _in_files(m).select("user_id", F.col("event_id").alias("id"), (F.floor("value") % 21 - 10).alias("pnl"))
    return ST.run_once(ST.drawdowns(rows, "user_id"), f"drawdown_{uuid.uuid4().hex}", "update", "key")


@query("SELECT user_id AS key, CAST(rank AS BIGINT) AS rank, event_id AS id, volume FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY volume DESC, event_id) AS rank FROM (SELECT user_id, event_id, CAST(floor(value * 100) AS BIGINT) AS volume FROM events)) WHERE rank <= 5")
def o06_top_five(m):
    """The five largest of each user, kept as a bounded state over several micro-batches."""
    rows = _in_files(m).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.floor(F.col("value") * 100).alias("volume"))
    with ST.rocksdb_state(m.spark):
        return ST.run_once(ST.top_rows(rows), f"top_{uuid.uuid4().hex}", "update", "key")
