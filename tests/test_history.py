"""Estimators at boundaries, interval algebra, filters before shuffles, bucketed tables and bounded state, against brute force and in their plans."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import boundaries as B
from tidemark.operators import calibration as C
from tidemark.operators import intervals as I  # noqa: E741
from tidemark.operators import storage as S
from tidemark.plans import upkeep
from tidemark.session import shared_folder
from tidemark.streaming import streams
from tidemark.testdata import Market

US = 1_000_000


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("unit", B.UNITS)
def test_rates_at_boundaries(spark, unit):
    """Each boundary by itself, from all rows settled strictly before it; a settlement on a boundary counts from the next one on."""
    draw = random.Random(1)
    start = datetime(2024, 1, 1)
    settled = {f"m{i}": start + timedelta(days=draw.randrange(0, 90), hours=draw.choice([0, 0, 7])) for i in range(60)}
    rows = [(draw.choice("ab"), draw.choice(["x", None]), draw.randrange(3), t, int((s - datetime(1970, 1, 1)).total_seconds()) * US, draw.random(), draw.random() > 0.5) for t, s in settled.items() for _ in range(draw.randrange(1, 5))]
    obs = spark.createDataFrame([*rows, ("a", "x", 1, "open", None, 0.5, True)], "gp string, topic string, price_bucket int, ticker string, settled_us long, price double, yes boolean")
    last = B.last_boundary(obs, unit)
    got = {(r.gp, r.topic, r.price_bucket, r.boundary): (r.n, r.n_markets, pytest.approx(r.avg_price), pytest.approx(r.rate)) for r in B.rates_at_boundaries(obs, last, unit).collect()}
    want = {}
    for boundary in {k[3] for k in got}:
        cells = {}
        for gp, topic, bucket, ticker, us, price, yes in rows:
            if us < (boundary - datetime(1970, 1, 1)).total_seconds() * US:
                cells.setdefault((gp, topic, bucket, boundary), []).append((ticker, price, yes))
        for cell, seen in cells.items():
            markets = {t: [y for u, _, y in seen if u == t] for t, _, _ in seen}
            want[cell] = (len(seen), len(markets), sum(p for _, p, _ in seen) / len(seen), sum(sum(y) / len(y) for y in markets.values()) / len(markets))
    assert set(got) == set(want) and all(got[k] == want[k] for k in want) and len({k[3] for k in got}) > 2
    # every boundary from a cell's first to the last is there
    step = {"day": timedelta(days=1), "week": timedelta(days=7)}.get(unit)
    if step:
        for cell in {k[:3] for k in got}:
            at = sorted(k[3] for k in got if k[:3] == cell)
            assert all(b - a == step for a, b in zip(at, at[1:], strict=False)) and at[-1] == max(k[3] for k in got)


def test_known_at_looks_no_further(spark):
    obs = spark.createDataFrame([("a", "x", 1, "m", 40 * 86_400 * US, 0.5, True)], "gp string, topic string, price_bucket int, ticker string, settled_us long, price double, yes boolean")
    last = B.last_boundary(obs, "month")
    points = spark.createDataFrame([("a", "x", 1, d * 86_400 * US) for d in (30, 45, 58, 59, 400)], "gp string, topic string, price_bucket int, at_us long")
    out = B.known_at(points, B.rates_at_boundaries(obs, last), ["gp", "topic", "price_bucket"], "at_us", "month", last)
    assert [r.rate for r in out.orderBy("at_us").collect()] == [None, None, None, 1.0, 1.0]


def test_intervals_by_days(spark):
    """Day by day: ranges that overlap, nest, touch, are empty or lie outside."""
    draw = random.Random(2)
    spans = [(k, a, a + draw.randrange(0, 40)) for k in range(60) for a in [draw.randrange(0, 20)]]
    ranges = [(k, a, a + draw.randrange(0, 12)) for k in range(70) for a in [draw.randrange(-10, 60) for _ in range(draw.randrange(0, 9))]]
    span_df = spark.createDataFrame(spans, "k int, low long, high long")
    range_df = spark.createDataFrame([*ranges, (3, None, 5)], "k int, start long, end long")
    days = {}
    for k, a, b in ranges:
        days.setdefault(k, set()).update(range(a, b))
    gaps = I.missing(span_df, range_df, ["k"])
    got, pieces = {}, {}
    for r in gaps.collect():
        assert not got.setdefault(r.k, set()) & set(range(r.start - 1, r.end + 1)), "gaps neither overlap nor touch"
        got[r.k].update(range(r.start, r.end))
    want = {k: left for k, low, high in spans if (left := set(range(low, high)) - days.get(k, set()))}
    assert got == want
    for r in I.chunks(gaps, F.lit(5)).collect():
        assert 0 < r.end - r.start <= 5 and not pieces.setdefault(r.k, set()) & set(range(r.start, r.end))
        pieces[r.k].update(range(r.start, r.end))
    assert pieces == want
    islands = I.union_of(range_df, ["k"]).collect()
    assert sorted((r.k, d) for r in islands for d in range(r.start, r.end)) == sorted((k, d) for k, s in days.items() for d in s)
    windows = [(k, a, a + 4) for k in range(70) for a in range(0, 40, 4)]
    open_ = I.uncovered(spark.createDataFrame(windows, "k int, start long, end long"), range_df, ["k"]).collect()
    assert sorted(map(tuple, open_)) == sorted(w for w in windows if not set(range(w[1], w[2])) <= days.get(w[0], set()))


def test_backfill_windows(spark):
    day = I.DAY
    markets = spark.createDataFrame([("a", 60, 400 * day), ("b", 1, 20 * day), ("c", 7, 20 * day)], "ticker string, resolution int, settled_s long")
    runs = spark.createDataFrame([("a", 60, 50 * day, 390 * day, "completed"), ("a", 60, 100 * day, 120 * day, "completed"), ("b", 1, 0, 19 * day, "failed")], "ticker string, resolution int, start long, end long, status string")
    got = sorted((r.ticker, r.number, r.start // day, r.end // day) for r in I.backfill_windows(markets, runs).collect())
    a = [("a", 0, 43, 50), ("a", 0, 393, 400), ("a", 1, 36, 43), ("a", 1, 390, 393), ("a", 2, 35, 36)]
    assert got == a + [("b", i, 19 - i, 20 - i) for i in range(14)]


def test_bloom_filter_before_the_shuffle(spark):
    """No key is lost, most others never reach the exchange, and the exact join takes the rest."""
    rows = spark.range(0, 200_000).select((F.col("id") % 50_000).cast("string").alias("k"), "id")
    keys = spark.range(0, 50_000, 100).select(F.col("id").cast("string").alias("k"))
    maybe = S.maybe_in(rows, "k", S.bloom_filter(keys, "k"))
    assert maybe.count() < 2000 * 1.05
    out = S.semi_join_filtered(rows, keys.unionByName(spark.createDataFrame([(None,)], "k string")), "k")
    assert out.count() == 2000 and out.select("k").distinct().count() == 500
    left = plan_of(out).split("== Initial Plan ==")[-1].split("SortMergeJoin")[1].split("Range")[0]  # from the exact join down to the first scan
    assert left.index("Exchange hashpartitioning(k") < left.index("BroadcastHashJoin") and "(_bits" in left


def test_bucketed_tables(spark):
    at = shared_folder(spark)
    for n, df in (("bq", spark.range(0, 3000).select((F.col("id") % 300).cast("string").alias("k"), F.col("id").alias("t"), (F.col("id") * 2).alias("v"))), ("bp", spark.range(0, 300).select(F.col("id").cast("string").alias("k"), F.lit(2000).cast("long").alias("end")))):
        spark.sql(f"DROP TABLE IF EXISTS {n}")
        S.write_bucketed(df, n, "k", ["t"] if n == "bq" else [], 8, f"{at}/{n}-{random.random()}")
    out = S.last_before(spark, "bq", "bp", "k", "t", "end", "v", ["v"])
    assert "Exchange" not in plan_of(out)
    assert {r.k: (r.t, r.v) for r in out.collect()} == {str(i): (t, 2 * t) for i in range(300) for t in [max(x for x in range(i, 2000, 300))]}
    # a point read opens the file of its bucket and no other: it works where all others are spoilt
    path = spark.table("bq").where("k = '17'").select(F.input_file_name()).first()[0].removeprefix("file://")
    for other in Path(path).parent.glob("part-*"):
        if other.name != Path(path).name:
            other.write_bytes(b"spoilt")
    spark.catalog.refreshTable("bq")
    assert S.rows_of(spark, "bq", "k", ["17"]).count() == 10


def test_top_rows_over_restarts(spark, tmp_path):
    """A second query goes on from the state that the first left; state has a row a key at most five times, and repeated ids count once."""
    source, log, got = str(tmp_path / "in"), str(tmp_path / "log"), {}
    draw = random.Random(3)
    seen = {}

    def keep(batch, _):
        fresh = {}
        for r in batch.collect():
            fresh.setdefault(r.key, []).append((r.rank, r.id, r.volume))
        got.update(fresh)

    for _ in range(2):
        for _ in range(3):
            rows = [(draw.randrange(4), draw.randrange(60), draw.randrange(100)) for _ in range(40)]
            for k, i, v in rows:
                seen[k, i] = max(v, seen.get((k, i), v))
            spark.createDataFrame(rows, "key long, id long, volume long").coalesce(1).write.mode("append").parquet(source)
        stream = streams.top_rows(streams.files(spark, source, "key long, id long, volume long", 1))
        with streams.rocksdb_state(spark):
            q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
        for k in got:
            best = sorted(((i, v) for (key, i), v in seen.items() if key == k), key=lambda r: (-r[1], r[0]))
            # an id that fell out can't come back with an older, larger volume: it was never in the five
            assert [(i, v) for _, i, v in sorted(got[k])] == best[:5]
        assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * 5 + 4


def test_one_row_a_key_over_batches(spark, sf):
    out = upkeep.st11_running_drawdown(Market(spark, sf))
    assert out.count() == out.select("key").distinct().count() and len(out.inputFiles()) > 2


def test_smoothing_by_recursion_and_by_fold(spark):
    draw = random.Random(6)
    rows = [(c, i, draw.random()) for c in [None, *"abcde"] for i in range(draw.randrange(1, 21))]
    df = spark.createDataFrame(rows, "cell string, i int, rate double")
    plain = {}
    for c in {r[0] for r in rows}:
        values = [v for k, _, v in sorted(r for r in rows if r[0] == c)]
        for i in range(len(values)):
            near = values[max(0, i - 2) : i + 3]
            values[i] = sum(near) / len(near)
            plain[c, i] = pytest.approx(values[i])
    for smoothed in (C.smoothed_recursively, C.smoothed_in_place):
        assert {(r.cell, r.i): r.smooth for r in smoothed(df, ["cell"], "i", "rate").collect()} == plain
