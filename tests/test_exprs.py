"""Scalar expressions and parsers against literal vectors."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.sources import parsers as P


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


def test_price_bucket(spark):
    got = values(spark, [(p,) for p in (0.02, 0.5, 0.92, 0.05, 0.99, 1.5, -0.1, 0.3)], "p double", X.price_bucket(F.col("p")))
    assert got == [0, 10, 18, 1, 19, None, None, 6]


def test_price_bucket_at_every_bound(spark):
    edges = [round(0.05 * i, 2) for i in range(20)]
    near = [x for e in edges for x in (e, e - 1e-12, e + 1e-12, e + 0.025)]
    want = [max((i for i, e in enumerate(edges) if e <= x), default=None) if x >= 0 else None for x in near]
    assert values(spark, [(x,) for x in near], "p double", X.price_bucket(F.col("p"))) == want


def test_time_buckets(spark):
    hours = [(h,) for h in (0.5, 1.0, 2.0, 48.0, -1.0)]
    assert values(spark, hours, "h double", X.report_time_bucket(F.col("h"))) == ["0-1h", "1-3h", "1-3h", "24h+", None]
    hours = [(float(h),) for h in (0.5, 1, 3, 6, 12, 24, 72, 200, -5)]
    assert values(spark, hours, "h double", X.flow_time_bucket(F.col("h"))) == ["<1h", "1-3h", "3-6h", "6-12h", "12-24h", "1-3d", "3-7d", "3-7d", "<1h"]


def test_volume_bucket(spark):
    assert values(spark, [(v,) for v in (0, 50, 500, 5000, 50000)], "v int", X.volume_bucket(F.col("v"))) == ["dead", "low", "moderate", "active", "high"]


def test_maker_fee(spark):
    pairs = [(90, 1), (50, 1), (90, 5), (50, 5), (90, 20), (97, 1), (50, 8), (0, 1), (100, 1)]
    assert values(spark, pairs, "p int, q int", X.fee(F.col("p"), F.col("q"))) == [1, 1, 1, 3, 4, 1, 4, 0, 0]


def test_tails(spark):
    rows = [(89, 92), (3, 8), (48, 52), (84, 96), (92, 89)]
    got = values(spark, rows, "b int, a int", X.tails(F.col("b"), F.col("a")))
    assert [[(t.side, t.mid, t.spread) for t in ts] for ts in got] == [[("yes", 90, 3)], [("no", 94, 5)], [], [], []]


def test_strike(spark):
    got = values(spark, [("KX-T60399.99",), ("A-215000",), ("A-LAKERS",), ("KXTEST-T-50",)], "t string", X.strike_of(F.col("t")))
    assert got == [60399.99, 215000.0, None, -50.0]


def test_edge_and_ev(spark):
    assert values(spark, [(0.03, 3.0), (0.03, 0.001)], "e double, d double", F.round(X.edge_per_day(F.col("e"), F.col("d")), 9)) == [0.01, 1.44]
    rows = [(0.95, 0.3, 0.7, 90, "yes"), (0.05, 0.3, 0.7, 90, "no"), (1.0, 1.0, 0.5, 90, "yes"), (0.95, 1.0, 1.0, 93, "yes")]
    ev = X.trade_ev(F.col("p"), F.col("w"), F.col("l"), F.col("x"), F.col("s"), F.lit(1))
    assert values(spark, rows, "p double, w double, l double, x int, s string", F.round(ev, 6)) == [-0.62, -0.62, 9.0, 1.0]


def test_opposing_flow(spark):
    rows = [("yes", 90, 89, "no", 10), ("yes", 90, 90, "no", 10), ("yes", 90, 91, "no", 10), ("yes", 90, 89, "yes", 10), ("no", 8, 92, "yes", 5), ("no", 8, 95, "yes", 5), ("no", 8, 91, "yes", 5), ("no", 8, 92, "no", 5)]
    got = values(spark, rows, "s string, l int, y int, t string, c int", X.opposing_flow(F.col("s"), F.col("l"), F.col("y"), F.col("t"), F.col("c")))
    assert got == [10, 10, 0, 0, 5, 5, 0, 0]


def test_cdf_lookup(spark):
    t, e = [1, 5, 10, 20, 50], [0.9, 0.8, 0.6, 0.4, 0.2]
    rows = [(t, e, q, n) for q, n in ((1, 100), (5, 100), (50, 100), (0, 100), (101, 500), (75, 100), (75, 500))] + [([], [], 5, 100), ([1, 100], [1.0, 0.0], 10, 1)]
    got = values(spark, rows, "t array<int>, e array<double>, q int, n int", F.round(X.cdf_lookup(F.col("t"), F.col("e"), F.col("q"), F.col("n")), 6))
    assert got[:6] == [0.9, 0.8, 0.2, 1.0, 0.0, 0.2] and 0.1 < got[6] < 0.2 and got[7:] == [0.0, 0.5]


def test_favorites(spark):
    rows = [(0.9, True), (0.1, False), (0.5, True)]
    got = values(spark, rows, "p double, y boolean", F.struct(X.favorite_price(F.col("p")).alias("p"), X.favorite_won(F.col("p"), F.col("y")).alias("w")))
    assert [(r.p, r.w) for r in got] == [(0.9, True), (0.9, True), (None, None)]


def test_relative_price_and_limit(spark):
    rows = [(90, 88, 92, "yes"), (10, 88, 92, "no"), (50, 60, 60, "yes"), (99, 88, 92, "yes")]
    got = values(spark, rows, "l int, b int, a int, s string", X.relative_price(F.col("l"), F.col("b"), F.col("a"), F.col("s")))
    assert got == [0.5, 0.5, 0.5, 1.0]
    assert values(spark, [(10, 15, 0.5), (10, 13, 0.5), (1, 2, 0.0)], "b int, a int, r double", X.limit_at(F.col("b"), F.col("a"), F.col("r"))) == [12, 12, 1]


def test_bad_side_raises(spark):
    one = [F.lit(1)] * 5
    with pytest.raises(Exception, match="no such side"):
        values(spark, [("maybe",)], "s string", X.touched(F.col("s"), *one))


def test_pnl(spark):
    rows = [(92, 100, 5, 2), (92, 0, 5, 2), (90, 100, 5, 1), (90, 0, 5, 1)]
    assert values(spark, rows, "e int, x int, c int, f int", X.pnl(F.col("e"), F.col("x"), F.col("c"), F.col("f"))) == [38, -462, 49, -451]


def test_snapshot_ladders(spark):
    rows = [([["0.85", "100"], ["0.84", "200"]], None, [["0.18", "150"], ["0.17", "50"]], None), (None, [["85", "100"], ["84", "200"]], None, [["18", "150"], ["17", "50"]])]
    schema = "yd array<array<string>>, y array<array<string>>, nd array<array<string>>, n array<array<string>>"
    got = values(spark, rows, schema, P.book_top(P.ladder(F.col("yd"), F.col("y")), P.ladder(F.col("nd"), F.col("n"))))
    assert [tuple(r) for r in got] == [(85, 82, 300, 200)] * 2


def test_candle_with_nulls(spark):
    body = json.dumps({"end_period_ts": 1700000000, "yes_bid": {"open": "22", "close": "21", "high": "24", "low": "20"}, "price": {"open": None}, "volume": 13683, "open_interest": 379323})
    r = P.candles(spark.createDataFrame([(body,), ("{}",)], "b string"), "b").collect()
    assert len(r) == 1 and (r[0].yes_bid_open, r[0].yes_bid_close, r[0].yes_bid_high, r[0].yes_bid_low, r[0].price_open, r[0].yes_ask_low, r[0].volume, r[0].open_interest) == (22, 21, 24, 20, None, None, 13683, 379323)


def test_model_answers(spark):
    rows = [('Here:\n```json\n{"a": "high"}\n```\nbye',), ('{"a": "0.5"}',), ("nothing",)]
    a = P.fenced_json(F.col("t"), "a string")["a"]
    assert values(spark, rows, "t string", P.confidence(a)) == [0.9, 0.5, None]


def test_daily_series(spark):
    df = spark.createDataFrame([("x", [[1.7e12, 5.0], [1.7e12 + 1000, 6.0]], [[1.7e12, 50.0], [1.7e12 + 1000, 60.0]])], "id string, prices array<array<double>>, volumes array<array<double>>")
    r = P.daily_series(df, "prices", "volumes", "id").collect()
    assert [(x.price, x.volume) for x in r] == [(5.0, 50.0)]


def test_settlement_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"action": "settlement", "ticker": "A", "pnl_cents": 5}\nbroken\n{"action": "order", "ticker": "B"}\n')
    assert [r.ticker for r in P.settlement_log(spark, str(tmp_path / "log.jsonl")).collect()] == ["A"]


def test_windows_newest_first(spark):
    done = spark.createDataFrame([("2021-02-01",)], "month string").select(F.to_date("month").alias("month"))
    got = [str(r.month) for r in P.api_windows(spark, "2021-01-15", "2021-04-02", done).collect()]
    assert got == ["2021-04-01", "2021-03-01", "2021-01-01"]


def test_options_chain(spark):
    body = json.dumps({"data": {"options": [{"option": "SPX240119C04500000", "bid": "1.5", "ask": "x"}, {"option": "bad"}]}})
    r = P.options_chain(spark.createDataFrame([(body,)], "b string"), "b").collect()
    assert (r[0].root, str(r[0].expiry), r[0].kind, r[0].strike, r[0].bid, r[0].ask) == ("SPX", "2024-01-19", "call", 4500.0, 1.5, None) and r[1].root is None
