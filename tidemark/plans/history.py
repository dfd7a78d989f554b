"""What was known when, what is still to be fetched, and what need not be read."""

import uuid

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import boundaries as B
from tidemark.operators import calibration as C
from tidemark.operators import intervals as I  # noqa: E741
from tidemark.operators import storage as S
from tidemark.plans.catalog import query
from tidemark.session import dealt, shared_folder, written

CELL = ("gp", "topic", "price_bucket")

KNOWN_SQL = """o AS (SELECT gp, topic, CAST(mid2 // 10 AS INTEGER) AS price_bucket, ticker, mid, yes, settled_us FROM observations),
span AS (SELECT min(date_trunc('month', make_timestamp(settled_us))) + INTERVAL 1 MONTH AS a, max(date_trunc('month', make_timestamp(settled_us))) + INTERVAL 1 MONTH AS b FROM o),
bounds AS (SELECT unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS boundary FROM span),
per_market AS (SELECT boundary, gp, topic, price_bucket, ticker, count(*) AS n, sum(mid) AS prices, avg(CAST(yes AS INTEGER)) AS mean FROM bounds JOIN o ON settled_us < epoch_us(boundary) GROUP BY ALL),
known AS (SELECT boundary, gp, topic, price_bucket, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_markets, sum(prices) / sum(n) AS avg_price, avg(mean) AS rate FROM per_market GROUP BY ALL)"""


def _cells(m):
    return m.observations.select("gp", "topic", X.price_bucket(F.col("mid")).alias("price_bucket"), "ticker", "settled_us", F.col("mid").alias("price"), "yes")


def _known(m):
    cells = _cells(m)
    last = B.last_boundary(cells, "month")
    return B.rates_at_boundaries(cells, last), last


@query(f"WITH {KNOWN_SQL} SELECT gp, topic, price_bucket, epoch_us(boundary) AS boundary_us, n, n_markets, round(avg_price, 9) AS avg_price, round(rate, 9) AS rate FROM known", "observations")
def c11_rates_at_boundaries(m):
    """A row for each cell and month from which on it is known."""
    table, _ = _known(m)
    return table.select(*CELL, F.unix_micros("boundary").alias("boundary_us"), "n", "n_markets", F.round("avg_price", 9).alias("avg_price"), F.round("rate", 9).alias("rate"))


@query(
    f"""WITH {KNOWN_SQL}, points AS (SELECT ticker, seq, gp, topic, CAST(mid2 // 10 AS INTEGER) AS price_bucket, least(date_trunc('month', make_timestamp(period_us)), (SELECT b FROM span)) AS boundary FROM observations)
    SELECT p.ticker, p.seq, epoch_us(p.boundary) AS boundary_us, k.n_markets, round(k.rate, 9) AS rate FROM points p LEFT JOIN known k USING (boundary, gp, topic, price_bucket)""",
    "observations",
)
def v06_estimates_as_of(m):
    """Each quote with the rate that was known at the start of its month."""
    table, last = _known(m)
    points = m.observations.select("ticker", "seq", "gp", "topic", X.price_bucket(F.col("mid")).alias("price_bucket"), "period_us")
    out = B.known_at(points, table, CELL, "period_us", "month", last)
    return out.select("ticker", "seq", F.unix_micros("boundary").alias("boundary_us"), "n_markets", F.round("rate", 9).alias("rate"))


@query(
    """WITH r AS (SELECT o.gp, o.topic, CASE WHEN o.hours < 24 THEN 'short' WHEN o.hours < 168 THEN 'medium' ELSE 'long' END AS time, o.settled_us, o.yes FROM observations o),
    span AS (SELECT min(date_trunc('week', make_timestamp(settled_us))) + INTERVAL 7 DAY AS a, max(date_trunc('week', make_timestamp(settled_us))) + INTERVAL 7 DAY AS b FROM r),
    bounds AS (SELECT unnest(generate_series(a, b, INTERVAL 7 DAY)) AS boundary FROM span)
    SELECT gp, topic, time, epoch_us(boundary) AS boundary_us, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(yes AS INTEGER)) AS BIGINT) AS won FROM bounds JOIN r ON settled_us < epoch_us(boundary) GROUP BY ALL""",
    "observations",
)
def c11_counts_at_boundaries(m):
    """Outcomes by process, topic and time to settlement, as known at each week."""
    time = F.when(F.col("hours") < 24, "short").when(F.col("hours") < 168, "medium").otherwise("long")
    rows = m.observations.select("gp", "topic", time.alias("time"), "settled_us", F.lit(1).alias("n"), F.col("yes").alias("won"))
    out = B.counts_at_boundaries(rows, B.last_boundary(rows, "week"), ["n", "won"], ["gp", "topic", "time"], "week")
    return out.select("gp", "topic", "time", F.unix_micros("boundary").alias("boundary_us"), "n", "won")


RUNS_SQL = """runs AS (SELECT l_orderkey AS k, [1, 60, 1440][1 + l_linenumber % 3] AS resolution, epoch_us(l_shipdate) // 1000000 - CAST(l_quantity AS BIGINT) * 86400 AS s, epoch_us(l_shipdate) // 1000000 + l_partkey % 10 * 86400 AS e FROM lineitem WHERE l_returnflag <> 'A'),
spans AS (SELECT o_orderkey AS k, r.resolution, epoch_us(o_orderdate) // 1000000 - r.days * 86400 AS low, epoch_us(o_orderdate) // 1000000 AS high, r.size * 86400 AS size FROM orders, (VALUES (1, 14, 1), (60, 365, 7), (1440, 1460, 90)) r(resolution, days, size)),
inside AS (SELECT p.k, p.resolution, s, e FROM runs r JOIN spans p ON r.k = p.k AND r.resolution = p.resolution WHERE s < e AND s < high AND e > low)"""


def _runs(m):
    resolution = F.element_at(F.array(F.lit(1), F.lit(60), F.lit(1440)), (1 + F.col("l_linenumber") % 3).cast("int"))
    day = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    status = F.when(F.col("l_returnflag") == "A", "failed").otherwise("completed")
    return m.raw("lineitem").select(F.col("l_orderkey").alias("ticker"), resolution.alias("resolution"), (day - F.col("l_quantity").cast("long") * I.DAY).alias("start"), (day + F.col("l_partkey") % 10 * I.DAY).alias("end"), status.alias("status"))


@query(
    f"""WITH {RUNS_SQL},
    points AS (SELECT k, resolution, low AS p, low, high, size FROM spans UNION SELECT p.k, p.resolution, e, low, high, size FROM inside i JOIN spans p ON i.k = p.k AND i.resolution = p.resolution WHERE e < high),
    gaps AS (SELECT k, resolution, size, p AS a, coalesce((SELECT min(s) FROM inside i WHERE i.k = q.k AND i.resolution = q.resolution AND s > p), high) AS b FROM points q WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.k = q.k AND i.resolution = q.resolution AND s <= p AND e > p))
    SELECT k AS ticker, resolution, i AS number, greatest(a, b - (i + 1) * size) AS from_s, b - i * size AS to_s FROM (SELECT *, unnest(generate_series(0, CAST(ceil((b - a) / size) AS BIGINT) - 1)) AS i FROM gaps)"""
)
def s07_backfill_windows(m):
    """What is to be fetched of each market at three resolutions, where completed ranges overlap, nest and touch. Markets and ranges are dealt out alike, by the number of both."""
    n = 3 * m.raw("orders").count() + m.raw("lineitem").count()
    by_key = lambda df: dealt(df, n, "ticker", "resolution", rows_a_task=400_000)
    markets = m.raw("orders").select(F.col("o_orderkey").alias("ticker"), F.explode(F.array(F.lit(1), F.lit(60), F.lit(1440))).alias("resolution"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("settled_s"))
    return I.backfill_windows(by_key(markets), by_key(_runs(m).where("status = 'completed'"))).withColumnsRenamed({"start": "from_s", "end": "to_s"})


@query(
    """WITH w AS (SELECT series, a, a + INTERVAL 1 MONTH AS b FROM (SELECT series, unnest(generate_series(date_trunc('month', make_timestamp(min(period_us))), make_timestamp(max(period_us)), INTERVAL 1 MONTH)) AS a FROM observations GROUP BY series)),
    d AS (SELECT DISTINCT series, CAST(date_trunc('day', make_timestamp(period_us)) AS TIMESTAMP) + INTERVAL (i) DAY AS day FROM observations, range(0, 10) g(i))
    SELECT w.series, epoch_us(a) // 1000000 AS from_s, epoch_us(b) // 1000000 AS to_s FROM w LEFT JOIN d ON w.series = d.series AND day >= a AND day < b GROUP BY w.series, a, b HAVING count(day) < date_diff('day', a, b)""",
    "observations",
)
def s06_uncovered_months(m):
    """Months of a series that completed ranges, ten days from each day with a quote, don't cover as a whole."""
    day = F.unix_seconds(F.date_trunc("day", F.timestamp_micros("period_us")))
    seen = m.observations.select("series", "period_us", day.alias("start"), (day + 10 * I.DAY).alias("end"))
    months = seen.groupBy("series").agg(F.date_trunc("month", F.timestamp_micros(F.min("period_us"))).alias("a"), F.timestamp_micros(F.max("period_us")).alias("b"))
    windows = months.select("series", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("a")).select("series", F.unix_seconds("a").alias("start"), F.unix_seconds(F.add_months("a", 1).cast("timestamp")).alias("end"))
    return I.uncovered(windows, seen.select("series", "start", "end").distinct(), ["series"]).withColumnsRenamed({"start": "from_s", "end": "to_s"})


@query("SELECT ticker, period_us, seq, bid FROM candles WHERE ticker IN (SELECT ticker FROM candles WHERE bid >= 85 OR bid <= 15) AND ticker IN (SELECT ticker FROM settled s JOIN classes c ON s.series = c.series WHERE result IS NOT NULL)", "candles", "classes")
def c10_tail_preload(m):
    """All quotes of settled, classified markets that have one at a tail price."""
    markets = m.settled.where("result IS NOT NULL").join(m.classes.select("series"), "series", "left_semi")
    return S.tail_preload(m.candles.select("ticker", "period_us", "seq", "bid"), markets, "bid")


@query("SELECT ticker, arg_max(period_us, (period_us, seq)) AS period_us, arg_max(bid, (period_us, seq)) AS bid FROM (SELECT c.*, s.settled_us FROM candles c JOIN settled s ON c.ticker = s.ticker WHERE period_us < settled_us) GROUP BY ticker", "candles")
def s18_bucketed_last_quotes(m, buckets=16):
    """Quotes and markets written once, bucketed by ticker; the as-of join of the two moves no row."""
    at, name = shared_folder(m.spark).rstrip("/"), uuid.uuid4().hex
    for table, df, order in ((f"quotes_{name}", m.candles.select("ticker", "period_us", "seq", "bid"), ["period_us"]), (f"markets_{name}", m.settled.select("ticker", "settled_us"), [])):
        S.write_bucketed(df, table, "ticker", order, buckets, f"{at}/{table}")
    return S.last_before(m.spark, f"quotes_{name}", f"markets_{name}", "ticker", "period_us", "settled_us", "seq", ["bid"])


@query(
    """WITH RECURSIVE v AS (SELECT gp, topic, CAST(mid2 // 10 AS INTEGER) AS price_bucket, avg(CAST(yes AS INTEGER)) AS rate FROM observations GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS i, lead(rate, 1) OVER w AS v1, lead(rate, 2) OVER w AS v2 FROM v WINDOW w AS (PARTITION BY gp, topic ORDER BY price_bucket)),
    s AS (SELECT gp, topic, price_bucket, i, CAST(NULL AS DOUBLE) AS b, list_avg([rate, v1, v2]) AS a FROM r WHERE i = 1
      UNION ALL SELECT r.gp, r.topic, r.price_bucket, r.i, s.a, list_avg([s.b, s.a, r.rate, r.v1, r.v2]) FROM s JOIN r ON r.gp = s.gp AND r.topic = s.topic AND r.i = s.i + 1)
    SELECT gp, topic, price_bucket, round(a, 9) AS smooth FROM s""",
    "observations",
)
def w04_recursive_smoothing(m):
    """Rates of each cell's price buckets, where each one sees what its left neighbours have become."""
    rates = written(_cells(m).groupBy(*CELL).agg(F.avg(F.col("yes").cast("int")).alias("rate")), "rates")
    return C.smoothed_recursively(rates, ["gp", "topic"], "price_bucket", "rate").select(*CELL, F.round("smooth", 9).alias("smooth"))
