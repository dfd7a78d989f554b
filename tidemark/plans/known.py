"""What was known at a boundary, and what streams leave behind: features, views, validation, runs, and late rows; each with its SQL."""

import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.framework import runlog as L
from tidemark.framework.artifacts import Store
from tidemark.framework.features import Cached, Computed, Preloaded, Registry, Stored
from tidemark.framework.views import Estimator, ViewFactory, classification_estimator, observations_feature, temporal_validation
from tidemark.ml import boosted as B
from tidemark.operators import sinks as K
from tidemark.plans.catalog import query
from tidemark.plans.formats import _folder
from tidemark.plans.upkeep import _in_files
from tidemark.sources import parsers as P
from tidemark.streaming import streams as ST

AT = datetime(1996, 5, 15, 13, 30, tzinfo=UTC)
BOUNDARIES = [datetime(1995, 7, 1, tzinfo=UTC), datetime(1996, 9, 1, tzinfo=UTC), datetime(1997, 3, 1, tzinfo=UTC), datetime(1998, 1, 1, tzinfo=UTC)]


def _us(t: datetime) -> int:
    return int(t.timestamp()) * 1_000_000


def _registry(m) -> Registry:
    registry = Registry()
    markets = m.settled.where("result IS NOT NULL").withColumn("settled_at", F.timestamp_micros("settled_us"))
    registry.register(Stored("settled", lambda: markets, "settled_at"))
    registry.register(Preloaded("classes", m.classes, lambda _: F.lit(True)))
    return registry


RATES_AT = "SELECT series, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (result = 'yes') AS BIGINT) AS n_yes FROM settled WHERE result IS NOT NULL AND settled_us < {at} GROUP BY series"


@query(f"SELECT 'computed' AS feature, * FROM ({RATES_AT.format(at=_us(AT))}) UNION ALL SELECT 'cached', * FROM ({RATES_AT.format(at=_us(AT.replace(hour=0, minute=0)))}) UNION ALL SELECT 'weekly', * FROM ({RATES_AT.format(at=_us(datetime(1996, 5, 13, tzinfo=UTC)))}) UNION ALL SELECT 'preloaded', series, CAST(count(*) AS BIGINT), CAST(count(*) FILTER (result = 'yes') AS BIGINT) FROM settled WHERE settled_us <= {_us(AT)} - 86400000000 GROUP BY series", "settled")
def v01_features_at(m):
    """One aggregate as a computed feature, cached for the day and for the week, and over a table that is cut by a rule of its own."""
    registry = _registry(m)
    rates = lambda df: df.groupBy("series").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "yes").alias("n_yes"))
    registry.register(Computed("computed", lambda f: rates(f["settled"]), ("settled",)))
    caches = [Cached(n, lambda f: rates(f["settled"]), ("settled",), bucket=b) for n, b in (("cached", "daily"), ("weekly", "weekly"))]
    for c in caches:
        registry.register(c)
    registry.register(Preloaded("loaded", m.settled, lambda t: F.col("settled_us") <= _us(t) - 86_400_000_000))
    registry.register(Computed("preloaded", lambda f: rates(f["loaded"]), ("loaded",)))
    registry.validate()
    out = None
    for name in ("computed", "cached", "weekly", "preloaded"):
        rows = registry.query(name, AT).select(F.lit(name).alias("feature"), "series", "n", "n_yes")
        out = rows if out is None else out.unionByName(rows)
    for c in caches:
        c.release()
    return out


@query(f"SELECT ticker, k.series, gp, topic, result FROM settled s JOIN (SELECT * FROM classes WHERE series <> 'S7') k ON s.series = k.series WHERE result IS NOT NULL AND settled_us < {_us(AT)}", "settled", "classes")
def v08_observations(m):
    """Settled markets with their class as of a boundary: those of a series without one are left out."""
    registry = _registry(m)
    registry.register(Preloaded("known", m.classes.where("series <> 'S7'"), lambda _: F.lit(True)))
    registry.register(observations_feature("observations", "settled", "known"))
    return registry.query("observations", AT).select("ticker", "series", "gp", "topic", "result")


@query(
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS view, s.ticker, r.rate FROM settled s JOIN classes k ON s.series = k.series LEFT JOIN (SELECT gp, round(avg(CASE result WHEN 'yes' THEN 1 ELSE 0 END), 9) AS rate FROM settled JOIN classes ON settled.series = classes.series WHERE result IS NOT NULL AND settled_us < {_us(BOUNDARIES[known])} GROUP BY gp) r ON k.gp = r.gp WHERE settled_us >= {_us(BOUNDARIES[i])} AND settled_us < {_us(BOUNDARIES[i + 1])}"
        for i, known in ((0, 0), (1, 1), (2, 1))
    ),
    "settled", "classes",
)
def v06_views_from_store(m):
    """Views at three boundaries: the first two are fitted and stored, as what is stored is too old for the second; the third loads it. Each answers for the markets that settle until the next."""
    rate = Estimator(
        "yes_rate", lambda f, t: f["settled"].join(t["classification"], "series").groupBy("gp").agg(F.round(F.avg(F.when(F.col("result") == "yes", 1).otherwise(0)), 9).alias("rate")),
        ("settled",), ("classification",), lambda table, asked: asked.join(table, "gp", "left"),
    )
    factory = ViewFactory(_registry(m), [rate, classification_estimator()], Store(m.spark, _folder(m, "artifacts")), timedelta(days=400))
    out = None
    for i, (a, b) in enumerate(zip(BOUNDARIES, BOUNDARIES[1:], strict=False)):
        view = factory.build(a)
        asked = m.settled.where((F.col("settled_us") >= _us(a)) & (F.col("settled_us") < _us(b))).select("ticker", "series")
        rows = view.answer("yes_rate", view.answer("classification", asked)).select(F.lit(i).alias("view"), "ticker", "rate")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    " UNION ALL ".join(
        f"SELECT CAST({_us(a)} AS BIGINT) AS boundary_us, CAST(count(*) AS BIGINT) AS n, round(avg(abs(rate - CASE result WHEN 'yes' THEN 1 ELSE 0 END)), 9) AS error FROM settled s LEFT JOIN (SELECT series, avg(CASE result WHEN 'yes' THEN 1 ELSE 0 END) AS rate FROM settled WHERE result IS NOT NULL AND settled_us < {_us(a)} GROUP BY series) r ON s.series = r.series WHERE result IS NOT NULL AND settled_us >= {_us(a)} AND settled_us < {_us(b)}"
        for a, b in zip(BOUNDARIES, BOUNDARIES[1:], strict=False)
    ),
    "settled",
)
def v09_temporal_validation(m):
    """The error of each series' rate at a boundary among the markets that settle until the next."""
    registry, yes = _registry(m), F.when(F.col("result") == "yes", 1).otherwise(0)
    fit = Estimator("rate", lambda f, _: f["settled"].groupBy("series").agg(F.avg(yes).alias("rate")), ("settled",), (), lambda table, asked: asked.join(table, "series", "left"))
    asked = lambda a, b: m.settled.where("result IS NOT NULL").where((F.col("settled_us") >= _us(a)) & (F.col("settled_us") < _us(b))).select("series", "result")
    out = temporal_validation(registry, fit, BOUNDARIES, asked, F.avg(F.abs(F.col("rate") - yes)))
    return out.select(F.unix_micros("boundary").alias("boundary_us"), "n", F.round("metric", 9).alias("error"))


@query("SELECT user_id AS run_id, CAST(sum(floor(value)) AS BIGINT) AS fetched, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS inserted, arg_max(event_type || event_id, event_id) AS cursor FROM events GROUP BY user_id")
def g02_run_progress(m):
    """Totals of runs from their progress rows, and where each would go on."""
    deltas = m.raw("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.floor("value").alias("fetched"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("inserted"), F.concat("event_type", "event_id").alias("cursor"))
    return L.progress(deltas)


@query("SELECT window_start, window_end FROM (SELECT DISTINCT o_custkey || '-' || strftime(o_orderdate, '%Y-%m') AS window_start, o_custkey || '-' || strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m') AS window_end FROM orders) w WHERE window_start NOT IN (SELECT o_custkey || '-' || strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0)")
def q20_remaining_windows(m):
    """Months of each customer that no completed run of the dataset covers; failed runs and those of other datasets cover none."""
    at, label = F.col("o_orderdate").cast("timestamp"), lambda t: F.concat_ws("-", "o_custkey", F.date_format(t, "yyyy-MM"))
    windows = m.raw("orders").select("*", label(at).alias("window_start"), label(F.add_months(at, 1)).alias("window_end"))
    runs = windows.select("window_start", "window_end", F.when(F.col("o_orderkey") % 2 == 0, "orders").otherwise("other").alias("dataset_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return L.remaining(windows.select("window_start", "window_end").distinct(), runs, "orders")


@query("SELECT CAST(g AS DATE) AS month FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '1999-12-01', INTERVAL 1 MONTH)) AS g) WHERE CAST(g AS DATE) NOT IN (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) FROM lineitem)")
def s06_month_windows(m):
    """Months of ten years, those left out that are fetched already."""
    done = m.raw("lineitem").select(F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).cast("date").alias("month"))
    return P.api_windows(m.spark, "1990-01-01", "1999-12-31", done)


@query("WITH d AS (SELECT *, 1 + CAST(epoch_us(ts) // 86400000000 AS BIGINT) - (SELECT CAST(min(epoch_us(ts)) // 86400000000 AS BIGINT) FROM events) AS day FROM events) SELECT CAST(t.day AS INTEGER) AS test_day, e.event_type, CAST(count(*) FILTER (e.day < t.day) AS BIGINT) AS train, CAST(count(*) FILTER (e.day = t.day) AS BIGINT) AS test FROM d e, (VALUES (4), (5), (6)) t(day) WHERE e.day <= t.day GROUP BY ALL")
def ml4_blocked_days(m):
    """Days counted from the first, and for each test day what trains and what tests."""
    e = B.with_day(m.raw("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), "us")
    out = None
    for d, (train, test) in zip((4, 5, 6), B.blocked_folds(e, "day"), strict=True):
        rows = train.withColumn("part", F.lit(0)).unionByName(test.withColumn("part", F.lit(1))).groupBy(F.lit(d).alias("test_day"), "event_type").agg(F.count_if(F.col("part") == 0).alias("train"), F.count_if(F.col("part") == 1).alias("test"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(avg(count / 50.0::DOUBLE), 9) AS predicted, round(avg(CASE taker_side WHEN 'yes' THEN 1.0 ELSE 0 END), 9) AS observed, round(avg(abs(count / 50.0::DOUBLE - CASE taker_side WHEN 'yes' THEN 1 ELSE 0 END)), 9) AS mae FROM tape GROUP BY user_id", "tape")
def q43_errors_by_group(m):
    """Predicted and observed means of each group, and how far apart they are row by row."""
    scored = m.tape.select("user_id", (F.col("count") / F.lit(50.0)).alias("predicted"), (F.col("taker_side") == "yes").cast("int").alias("filled"))
    return B.by_group(scored, "user_id", "filled").select("user_id", "n", *[F.round(c, 9).alias(c) for c in ("predicted", "observed", "mae")])


@query("SELECT e.event_id AS k, CASE WHEN h.event_id IS NULL THEN 'live' ELSE 'historical' END AS origin, CAST(CASE WHEN h.event_id IS NULL THEN floor(e.value) ELSE -floor(h.value) - 1 END AS BIGINT) AS v FROM events e LEFT JOIN events h ON h.event_id // 2 = e.event_id AND h.event_id % 3 = 0")
def st05_late_corrections(m):
    """Live rows in micro-batches, and historical ones that correct rows of the same or of earlier batches: a table that each batch is spliced into."""
    live = F.struct(F.col("event_id").alias("k"), F.lit("live").alias("origin"), F.floor("value").alias("v"))
    late = F.when(F.col("event_id") % 3 == 0, F.struct(F.floor(F.col("event_id") / 2).alias("k"), F.lit("historical").alias("origin"), (-F.floor("value") - 1).alias("v")))
    rows = _in_files(m).select(F.explode(F.array(live, late)).alias("r")).where("r IS NOT NULL").select("r.*")
    path = _folder(m, "corrected")
    ST.spliced(rows, path, ["k"], _folder(m, "corrected-state")).start().awaitTermination()
    return K.published(m.spark, path, rows.schema)


@query("SELECT event_id, n_name AS name FROM events LEFT JOIN nation ON user_id = n_nationkey")
def st12_stream_with_names(m):
    """A stream with names of a table that stands still; rows without one stay."""
    names = m.raw("nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("name"))
    return ST.run_once(ST.with_static(_in_files(m).select("event_id", "user_id"), names, "user_id"), f"named_{uuid.uuid4().hex}").select("event_id", "name")


@query("SELECT event_id, user_id FROM events")
def st06_polled_and_restarted(m):
    """A stream that is polled, stopped once it has caught up, and started again from its checkpoint: each row once."""
    rows, path, state = _in_files(m).select("event_id", "user_id"), _folder(m, "polled"), _folder(m, "polled-state")
    for _ in range(2):
        if not ST.stopped(ST.polled(rows, path, state, "1 second").start()):
            raise TimeoutError("the stream didn't stop")
    return m.spark.read.schema(rows.schema).parquet(path)
