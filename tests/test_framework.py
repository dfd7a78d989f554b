"""Point-in-time features, artifacts, views, sources and streams."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.framework import features as V
from tidemark.framework.artifacts import Store
from tidemark.framework.runlog import latest, progress, remaining, run_steps
from tidemark.framework.views import Estimator, ViewFactory, event_rate_estimator, temporal_validation
from tidemark.sources import rest
from tidemark.streaming import streams as ST

NOON = datetime(2025, 6, 15, 14, 30, 45)


def test_boundaries():
    assert V.boundary(NOON, "daily") == datetime(2025, 6, 15, tzinfo=UTC)
    assert V.boundary(NOON, "hourly") == datetime(2025, 6, 15, 14, tzinfo=UTC)
    assert V.boundary(NOON, "weekly") == datetime(2025, 6, 9, tzinfo=UTC)
    with pytest.raises(ValueError, match="monthly"):
        V.boundary(NOON, "monthly")


def test_order_and_cycles():
    assert V.in_order({"d": ["b", "c"], "b": ["a"], "c": ["a"], "a": []}) == ["a", "b", "c", "d"]
    for needs in ({"a": ["a"]}, {"a": ["b"], "b": ["a"]}, {"a": ["x"]}):
        with pytest.raises(ValueError):
            V.in_order(needs)


@pytest.fixture
def registry(spark):
    days = spark.createDataFrame([(i, datetime(2025, 6, 1 + i)) for i in range(10)], "v int, at timestamp")
    out = V.Registry()
    out.register(V.Stored("days", lambda: days, "at"))
    out.register(V.Computed("total", lambda f: f["days"].agg(F.sum("v").alias("s")), ["days"]))
    out.register(V.Cached("daily", lambda f: f["days"].agg(F.count("*").alias("n")), ["days"]))
    return out


def test_strict_boundary(registry):
    assert registry.query("days", datetime(2025, 6, 3)).count() == 2
    assert registry.query("total", datetime(2025, 6, 4)).first().s == 3
    assert registry.query("daily", datetime(2025, 6, 4, 23)).first().n == 3
    twin = registry.clone()
    assert twin.get("daily").held == {} and twin.get("total").registry is twin
    with pytest.raises(ValueError):
        registry.register(registry.get("days"))


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    at = lambda d: datetime(2025, 1, d, tzinfo=UTC)
    for d in (1, 5, 9):
        store.save("rates", at(d), spark.range(d))
    assert store.load("rates", at(5))[0] == at(5) and store.load("rates", at(8))[1].count() == 5
    assert store.load("rates", at(1) - timedelta(seconds=1)) is None
    assert store.load("rates", at(8), timedelta(days=1)) is None
    assert store.metadata().count() == 3


def test_views(spark, registry, tmp_path):
    fitted = []

    def calibrate(f, _):
        fitted.append(1)
        return f["days"].agg(F.avg("v").alias("mean"))

    mean = Estimator("mean", calibrate, ["days"], [], lambda t, q: q.crossJoin(t))
    factory = ViewFactory(registry, [mean], Store(spark, str(tmp_path)))
    view = factory.build(datetime(2025, 6, 6))
    assert view.answer("mean", spark.range(2)).collect()[0].mean == 2.0
    factory.build(datetime(2025, 6, 7))
    assert len(fitted) == 1
    assert factory.build(datetime(2025, 6, 7), recalibrate=True).answer("mean", spark.range(1)).first().mean == 2.5
    with pytest.raises(KeyError):
        view.answer("other", spark.range(1))
    with pytest.raises(ValueError):
        type(view)(view.as_of, registry, available={"late": view.as_of + timedelta(1)})
    scores = temporal_validation(registry, mean, [datetime(2025, 6, 3), datetime(2025, 6, 6), datetime(2025, 6, 9)], lambda a, b: registry.query("days", b).where(F.col("at") >= a), F.avg(F.abs(F.col("v") - F.col("mean")))).collect()
    assert [r.n for r in scores] == [3, 3] and [r.metric for r in scores] == [2.5, 4.0]


def test_event_rate_estimator(spark):
    rows = [(f"t{i}", "g", "x", float(i), i % 5 != 0, "s", i, i, 0.92, datetime(2025, 1, 1)) for i in range(60)]
    obs = spark.createDataFrame(rows, "ticker string, gp string, topic string, hours double, yes boolean, source string, period_us long, seq long, price double, settled_at timestamp")
    registry = V.Registry()
    registry.register(V.Stored("observations", lambda: obs, "settled_at"))
    view = ViewFactory(registry, [event_rate_estimator()]).build(datetime(2025, 1, 2))
    q = spark.createDataFrame([("g", "x", 10.0, 0.93), ("g", "x", 100.0, 0.93), ("z", "x", 1.0, 0.5)], "gp string, topic string, hours double, price double")
    got = {(r.gp, r.hours): r.p_yes for r in view.answer("event_rate", q).collect()}
    assert abs(got["g", 10.0] - 0.8) < 0.1 and got["g", 100.0] is None and got["z", 1.0] is None


def test_run_log(spark):
    deltas = spark.createDataFrame([(1, 1, 100, 95, "a"), (1, 2, 50, 48, "b")], "run_id long, seq int, fetched long, inserted long, cursor string")
    assert tuple(progress(deltas).first()) == (1, 150, 143, "b")
    runs = spark.createDataFrame([(1, "d", 5, "completed", "w1", "w2"), (2, "d", 9, "failed", "w2", "w3")], "run_id long, dataset_id string, started_us long, status string, window_start string, window_end string")
    assert latest(runs).first().run_id == 2
    windows = spark.createDataFrame([("w1", "w2"), ("w2", "w3")], "window_start string, window_end string")
    assert [r.window_start for r in remaining(windows, runs, "d").collect()] == ["w2"]
    out = run_steps({"bad": lambda: 1 / 0, "good": lambda: 2})
    assert isinstance(out["bad"], ZeroDivisionError) and out["good"] == 2


def test_list_source(spark):
    def fake_fetch(request):
        start = int(request["cursor"] or 0)
        rows = [(request["window"], i) for i in range(start, min(start + 3, 7))]
        return rows, str(start + 3) if start + 3 < 7 else None

    source = rest.list_source("fake_list", "window string, i int", fake_fetch, [{"window": "a"}, {"window": "b"}])
    spark.dataSource.register(source)
    assert sorted(map(tuple, spark.read.format("fake_list").load().collect())) == [(w, i) for w in "ab" for i in range(7)]
    keys = spark.range(11).withColumnRenamed("id", "k")
    got = rest.by_keys(keys, "k", "k long, n int", lambda ks: [(k, len(ks)) for k in ks], batch=4, tasks=2)
    assert sorted(r.k for r in got.collect()) == list(range(11)) and max(r.n for r in got.collect()) <= 4


def test_retry_and_rate():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise rest.HttpError(429)
        return "ok"

    assert rest.with_retry(flaky, sleep=waits.append) == "ok" and len(waits) == 2
    with pytest.raises(rest.HttpError):
        rest.with_retry(lambda: (_ for _ in ()).throw(rest.HttpError(404)), sleep=waits.append)
    now, slept = [0.0], []
    bucket = rest.Bucket(10, lambda: now[0], slept.append)
    for _ in range(3):
        bucket.take()
    assert [round(s, 3) for s in slept] == [0.1, 0.2]
    assert list(rest.offsets(lambda r: list(range(r["offset"], min(r["offset"] + r["limit"], 7))), {}, 3)) == list(range(7))


def test_late_rows_are_spliced(spark, tmp_path):
    from tidemark.operators.sinks import published

    rows = lambda *r: spark.createDataFrame(list(r), "k int, origin string, v int")
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for batch in (rows((1, "live", 1), (2, "historical", 2)), rows((1, "historical", 10), (2, "live", 20), (3, "live", 3))):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = ST.files(spark, source, "k int, origin string, v int")
        ST.spliced(stream, table, ["k"], str(tmp_path / "ck")).start().awaitTermination()
    assert sorted((r.k, r.v) for r in published(spark, table).collect()) == [(1, 10), (2, 2), (3, 3)]


def test_models(spark):
    from tidemark.ml import boosted as B

    rows = spark.createDataFrame([(float(i % 10), i % 10 > 4, int(i % 10 > 4), i * 86_400_000_000 // 100) for i in range(400)], "x double, won boolean, filled int, at_us long")
    model = B.classifier(rows, ["x"], "filled", maxIter=5, minInstancesPerNode=5)
    scored = B.probability(model, rows)
    assert B.by_group(scored, None, "filled").first().mae < 0.2
    days = B.with_day(rows, "at_us")
    folds = B.blocked_folds(days, "day", (2, 3))
    assert [(a.count(), b.count()) for a, b in folds] == [(100, 100), (200, 100)]
    assert B.baseline_error(rows, ["won"], "filled").first()[0] == 0.0


def test_observations_with_and_without_classes(spark):
    from tidemark.framework.views import observations_feature

    registry = V.Registry()
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 1)], "series string, k int")
    classes = spark.createDataFrame([("a", "g", "t"), ("a", "f", "u"), (None, "n", "n")], "series string, gp string, topic string")
    registry.register(V.Preloaded("rows", rows, lambda _: F.lit(True)))
    registry.register(V.Preloaded("classes", classes, lambda _: F.lit(True)))
    registry.register(observations_feature("inner", "rows", "classes"))
    registry.register(observations_feature("left", "rows", "classes", inner=False))
    got = {n: sorted((r.k, r.series, r.gp, r.topic) for r in registry.query(n, datetime(2024, 1, 1)).collect()) for n in ("inner", "left")}
    assert got["inner"] == [(1, "a", "f", "u"), (1, "a", "f", "u")]
    assert got["left"] == [(1, "a", "f", "u"), (1, "a", "f", "u"), (2, "b", "unknown", "unknown"), (3, None, "unknown", "unknown")]
