"""Joins and models against literal loops."""

import math
import random
import time
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.operators import calibration as C
from tidemark.operators import flow as W
from tidemark.operators import joins as J
from tidemark.operators import sinks as K
from tidemark.operators import strategy as S
from tidemark.operators import track as T
from tidemark.operators import virtual as V


def test_queue_positions(spark):
    rng = random.Random(1)
    orders, tape = [], []
    for i in range(60):
        side, limit = rng.choice(["yes", "no"]), rng.randint(85, 97)
        orders.append((i, f"m{i}", side, limit, rng.randint(1, 30), rng.randint(0, 40), 100, 900))
        for k in range(rng.randint(0, 40)):
            price = limit + rng.randint(-3, 3)
            tape.append((f"m{i}", rng.randint(50, 950), i * 100 + k, price if side == "yes" else 100 - price, rng.choice(["yes", "no"]), rng.randint(1, 15)))
    want = {}
    for oid, ticker, side, limit, quantity, ahead, start, end in orders:
        queue, got = ahead, 0
        for t, ts, _, yes, taker, count in sorted((x for x in tape if x[0] == ticker), key=lambda x: (x[1], x[2])):
            price = yes if side == "yes" else 100 - yes
            if not start <= ts <= end or taker == side or price > limit or got >= quantity:
                continue
            if price < limit:
                queue = 0
            served = min(queue, count)
            queue -= served
            got += min(quantity - got, count - served)
        want[oid] = got
    o = spark.createDataFrame(orders, "order_id int, ticker string, side string, limit int, quantity int, ahead int, placed_us long, end_us long")
    t = spark.createDataFrame(tape, "ticker string, ts_us long, trade_id long, yes_cents int, taker_side string, count int")
    got = {r.order_id: r.filled for r in W.fill_summary(o, W.queue_fills(o, t)).collect()}
    assert got == want


def test_tape_fill_vector(spark):
    o = spark.createDataFrame([(1, "m", "yes", 90, 12, 0, 100)], "order_id int, ticker string, side string, limit int, quantity int, placed_us long, end_us long")
    t = spark.createDataFrame([("m", 10, 1, 88, "no", 10), ("m", 20, 2, 89, "no", 5), ("m", 30, 3, 91, "no", 20), ("m", 0, 4, 88, "no", 9), ("m", 100, 5, 88, "no", 9)], "ticker string, ts_us long, trade_id long, yes_cents int, taker_side string, count int")
    assert [r.fill for r in W.tape_fills(o, t).orderBy("ts_us").collect()] == [10, 2]


def obs(spark, rows):
    return spark.createDataFrame(rows, "ticker string, gp string, topic string, hours double, yes boolean, source string, period_us long, seq long, price double")


def test_adaptive_cells(spark):
    for markets, slices in ((30, 0), (50, 1), (300, 10), (1000, 20)):
        rows = [(f"t{i}", "g", "x", float(i % 100), i % 7 != 0, "s", i, i, 0.92) for i in range(markets)]
        got = C.event_rates(obs(spark, rows), "price", sources=("s",)).collect()
        assert len(got) == slices
        assert all(abs(r.p_yes - 6 / 7) < 0.1 for r in got)
    two = [(f"t{i % 50}", "g", "x", float(i), True, "s", i, i, 0.92) for i in range(100)]
    assert [(r.n, r.n_markets) for r in C.event_rates(obs(spark, two), "price", sources=("s",)).collect()] == [(100, 50)]


def test_smoothing(spark):
    df = spark.createDataFrame([("a", 0, 0.9, 1000), ("a", 1, 0.5, 10)], "k string, i int, v double, w int")
    assert abs([r.smooth for r in C.smoothed(df, ["k"], "i", "v", "w").orderBy("i").collect()][0] - 0.896) < 0.01
    got = [r.smooth for r in C.smoothed_in_place(df, ["k"], "i", "v").orderBy("i").collect()]
    assert got[0] == 0.7 and abs(got[1] - 0.6) < 1e-12
    long = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 5, 2, 8, 3, 9])], "k string, i int, v double")
    want = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0]
    for i in range(6):
        near = want[max(0, i - 2) : i + 3]
        want[i] = sum(near) / len(near)
    got = [r.smooth for r in C.smoothed_in_place(long, ["k"], "i", "v").orderBy("i").collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_best_source(spark):
    df = spark.createDataFrame([("a", "hourly"), ("a", "hourly"), ("a", "snapshot"), ("b", "snapshot")], "ticker string, source string")
    got = sorted(map(tuple, C.best_source(df, "ticker", "source", ["hourly", "snapshot"]).collect()))
    assert got == [("a", "hourly"), ("a", "hourly"), ("b", "snapshot")]


def test_asof_against_loop(spark):
    rng = random.Random(2)
    right = [(f"k{rng.randint(0, 5)}", rng.randint(0, 100), i, i * 10) for i in range(300)]
    left = [(f"k{rng.randint(0, 7)}", rng.randint(0, 100), i) for i in range(100)]
    r, q = spark.createDataFrame(right, "k string, t int, seq int, v int"), spark.createDataFrame(left, "k string, at int, id int")
    for strict in (True, False):
        got = {x.id: x.v for x in J.asof_last(q, r, "k", "at", "t", ["v"], strict, ["seq"]).collect()}
        for k, at, i in left:
            seen = [(t, s, v) for kk, t, s, v in right if kk == k and (t < at or not strict and t == at)]
            assert got[i] == (max(seen)[2] if seen else None)


def test_band_takes_first(spark):
    bands = spark.createDataFrame([("g", 0, 0.0, 5.0, 0.1), ("g", 1, 5.0, 9.0, 0.2)], "g string, i int, a double, b double, p double")
    left = spark.createDataFrame([("g", 5.0), ("g", 9.0), ("g", 9.5), ("h", 1.0)], "g string, x double")
    got = {(r.g, r.x): r.p for r in J.band(left, bands, ["g"], "x", "a", "b", "i", ["p"]).collect()}
    assert got == {("g", 5.0): 0.1, ("g", 9.0): 0.2, ("g", 9.5): None, ("h", 1.0): None}


def test_flow_fallback(spark):
    def table(level, time, side, vol, price, outcome, n, n_outcome, p):
        return (level, "g", "t", time, side, vol, price, outcome, n_outcome, [p] * 8, n)

    rows = [table(1, "1-3h", "yes", "low", "90", o, 100, 50, 0.9) for o in ("won", "lost")] + [table(2, "1-3h", "yes", "*", "90", o, 300, 150, p) for o, p in (("won", 0.7), ("lost", 0.8))] + [table(6, "short", "*", "*", "*", "*", 900, 900, 0.4)]
    t = spark.createDataFrame(rows, "level int, gp string, topic string, time_bucket string, side string, vol_bucket string, price string, outcome string, n_outcome long, exceed array<double>, n_observations long")
    orders = spark.createDataFrame([(1, "g", "t", 2.0, "yes", 1, 90, 50), (2, "g", "t", 2.0, "no", 1, 90, 50), (3, "z", "t", 2.0, "no", 1, 90, 50)], "order_id int, gp string, topic string, hours double, side string, quantity int, limit int, volume int")
    got = {r.order_id: (r.level, r.p_won, r.p_lost) for r in W.fill_probability(orders, t).collect()}
    assert got == {1: (2, 0.7, 0.8), 2: (6, 0.4, 0.4), 3: (None, None, None)}


def test_ev_scan_against_loop(spark):
    rng = random.Random(3)
    markets = [(f"e{i // 3}-m{i}", f"e{i // 3}", "g", "t", 30.0, b := rng.randint(5, 90), b + rng.randint(1, 8), rng.random()) for i in range(30)]
    fills = [("g", "t", "<72h", s, k, rng.random(), rng.random()) for s in ("yes", "no") for k in range(11)]
    rate = {(s, k): (w, l) for *_, s, k, w, l in fills}
    import math

    best = {}
    for ticker, event, *_, bid, ask, p in markets:
        top = (0.0, None)
        for side in ("yes", "no"):
            low, high = (bid, ask) if side == "yes" else (100 - ask, 100 - bid)
            for k in range(11):
                limit = low + round(k / 10 * (high - low))
                fee = 0 if limit >= 100 else math.ceil(round(0.0175 * limit / 100 * (1 - limit / 100) * 100, 9))
                q = p if side == "yes" else 1 - p
                w, l = rate[side, k]
                ev = round(q * w * (100 - limit - fee) - (1 - q) * l * (limit + fee), 9)
                if ev > top[0]:
                    top = (ev, (side, limit))
        if top[1]:
            total = top[0] * min(5, max(1, 400 // top[1][1]))
            if total > best.get(event, (0,))[0]:
                best[event] = (total, ticker, *top[1])
    m = spark.createDataFrame(markets, "ticker string, event_ticker string, gp string, topic string, hours double, bid int, ask int, p_event double")
    f = spark.createDataFrame(fills, "gp string, topic string, time_bucket string, side string, step int, rate_won double, rate_lost double")
    got = {r.event_ticker: (r.ticker, r.side, r.limit) for r in S.ev_scan(m, f).collect()}
    assert got == {e: v[1:] for e, v in best.items()}


CANDIDATE = "scenario string, period_us long, rank int, ticker string, event_ticker string, side string, price int, contracts int, filled int, filled_us long, settled_us long, result string"


def test_replay_cash(spark):
    """Vectors: 38 and -462 for 5 at 92, 918 and -82 for 10 at 8, after a fee; three orders of 50 with 120 in cash are two trades."""
    fee = lambda p, q: math.ceil(round(0.0175 * q * p / 100 * (1 - p / 100) * 100, 9))
    rows = [("s", 1, i, f"t{i}", f"e{i}", "yes", 50, 1, 1, 1, 10, "yes") for i in range(3)] + [("s", 5, 0, None, *[None] * 8), ("s", 20, 0, "t9", "e9", "no", 8, 10, 10, 21, 30, "yes"), ("s", 25, 0, None, *[None] * 8)]
    got = sorted((r.ticker, r.pnl) for r in S.replay(spark.createDataFrame(rows, CANDIDATE), cash=120).collect())
    assert got == [("t0", 49), ("t1", 49), ("t9", -80 - fee(8, 10))]
    few = S.replay(spark.createDataFrame(rows, CANDIDATE), cash=1000, limits=S.Limits(positions=1, event=0.05, deployed=0.06)).collect()
    assert sorted(r.ticker for r in few) == ["t0"]  # 80 for t9 are over 5% of the cash
    vectors = [("a", "yes", 92, 5, "yes", 38), ("b", "yes", 92, 5, "no", -462), ("c", "no", 8, 10, "no", 918), ("d", "no", 8, 10, "yes", -82)]
    rows = [row for n, side, price, q, result, _ in vectors for row in ((n, 1, 0, "T1", "E", side, price, q, q, 1, 10, result), (n, 2, 0, None, *[None] * 8))]
    got = {r.scenario: r.pnl + r.fee for r in S.replay(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert got == {n: pnl + 2 for n, *_, pnl in vectors}


def test_fills_after_settlement_do_not_count(spark):
    rows = [("s", 1, 0, "t", "e", "yes", 50, 1, 1, 15, 10, "yes"), ("s", 5, 0, None, *[None] * 8), ("s", 20, 0, "u", "e", "yes", 50, 2, 2, 20, 40, "no"), ("s", 30, 0, None, *[None] * 8)]
    assert [(r.ticker, r.contracts) for r in S.replay(spark.createDataFrame(rows, CANDIDATE), cash=120).collect()] == [("u", 2)]


def replay_by_events(rows, cash, limits):
    """One scenario, step by step: settle what is filled, then what is pending, then see fills, then place."""
    escrow, pending, filled, trades = 0, {}, {}, []
    fee = lambda p, q: 0 if q == 0 or not 0 < p < 100 else math.ceil(round(0.0175 * q * p / 100 * (1 - p / 100) * 100, 9))
    for period in sorted({r[1] for r in rows}):
        for ticker in list(filled):
            if filled[ticker]["settled"] <= period:
                o = filled.pop(ticker)
                escrow -= o["cost"]
                exit_ = 100 if o["side"] == o["result"] else 0
                cash += exit_ * o["n"] - fee(o["price"], o["n"])
                trades.append((ticker, o["n"], (exit_ - o["price"]) * o["n"] - fee(o["price"], o["n"])))
        for ticker in list(pending):
            if pending[ticker]["settled"] <= period:
                o = pending.pop(ticker)
                escrow -= o["cost"]
                cash += o["price"] * (o["n"] - o["got"])
                if o["got"]:
                    exit_ = 100 if o["side"] == o["result"] else 0
                    cash += exit_ * o["got"] - fee(o["price"], o["got"])
                    trades.append((ticker, o["got"], (exit_ - o["price"]) * o["got"] - fee(o["price"], o["got"])))
        for ticker in list(pending):
            o = pending[ticker]
            if o["at"] <= period:
                o["got"] = min(o["fills"], o["n"])
                if o["got"] >= o["n"]:
                    filled[ticker] = pending.pop(ticker)
        if len(pending) + len(filled) >= limits.positions:
            continue
        equity = cash + escrow
        for _, _, _, ticker, event, side, price, n, fills, at, settled, result in sorted((r for r in rows if r[1] == period and r[3] is not None), key=lambda r: (r[2], r[3])):
            cost = price * n
            everything = [*pending.values(), *filled.values()]
            if ticker in pending or ticker in filled or cost > cash or settled <= period or escrow + cost > limits.deployed * equity:
                continue
            if sum(o["cost"] for o in everything if o["event"] == event) + cost > limits.event * equity:
                continue
            pending[ticker] = {"event": event, "side": side, "price": price, "n": n, "fills": fills, "at": at, "settled": settled, "result": result, "cost": cost, "got": 0}
            cash, escrow = cash - cost, escrow + cost
    for ticker, o in [*filled.items(), *pending.items()]:
        if o["got"]:
            exit_ = 100 if o["side"] == o["result"] else 0
            trades.append((ticker, o["got"], (exit_ - o["price"]) * o["got"] - fee(o["price"], o["got"])))
    return sorted(trades)


def test_replay_against_a_loop(spark):
    rng = random.Random(5)
    rows = []
    for s in range(6):
        for i in range(150):
            period = rng.randrange(0, 60)
            n = rng.randrange(1, 6)
            rows.append((f"s{s}", period, rng.randrange(3), f"t{rng.randrange(40)}", f"e{rng.randrange(8)}", rng.choice(["yes", "no"]), rng.randrange(3, 98), n, rng.randrange(0, n + 1), period + rng.randrange(0, 20), period + rng.randrange(0, 30), rng.choice(["yes", "no"])))
    limits = S.Limits(deployed=0.5, event=0.2, positions=6)
    got = defaultdict(list)
    for r in S.replay(spark.createDataFrame(rows, CANDIDATE), cash=1500, limits=limits).collect():
        got[r.scenario].append((r.ticker, r.contracts, r.pnl))
    for s in range(6):
        want = replay_by_events([r for r in rows if r[0] == f"s{s}"], 1500, limits)
        assert sorted(got[f"s{s}"]) == want and len(want) > 5


def test_queue_summary_against_a_loop(spark):
    rng = random.Random(6)
    tape = [(f"T{rng.randrange(3)}", rng.randrange(0, 60), i, rng.randrange(84, 94), rng.choice(["yes", "no"]), rng.randrange(1, 9)) for i in range(600)]
    orders = []
    for i in range(250):
        at, side = rng.randrange(0, 50), rng.choice(["yes", "no"])
        orders.append((i, f"T{rng.randrange(3)}", side, rng.randrange(85, 94) if side == "yes" else rng.randrange(6, 16), rng.randrange(1, 40), rng.randrange(0, 30), at, at + rng.randrange(0, 30)))
    frame = spark.createDataFrame(orders, "order_id long, ticker string, side string, limit int, quantity int, ahead int, placed_us long, end_us long")
    prints = spark.createDataFrame(tape, "ticker string, ts_us long, trade_id long, yes_cents int, taker_side string, count int")
    got = {r.order_id: (r.filled, r.first_s) for r in W.queue_summary(frame, prints).collect()}
    for i, ticker, side, limit, quantity, ahead, placed, end in orders:
        filled, first, swept = 0, None, False
        for t, at, _, cents, taker, n in sorted(tape, key=lambda r: (r[1], r[2])):
            price = cents if side == "yes" else 100 - cents
            if t != ticker or not placed <= at <= end or taker == side or price > limit:
                continue
            swept = swept or price < limit
            if not swept:
                n, ahead = max(0, n - ahead), max(0, ahead - n)
            n = min(n, quantity - filled)
            if n and first is None:
                first = (at - placed) / 1e6
            filled += n
        assert got[i] == (filled, first), i
    slow = {r.order_id: (r.filled, r.first_s) for r in W.fill_summary(frame, W.queue_fills(frame, prints)).collect()}
    assert slow == got


def test_best_pairs_against_all_pairs(spark):
    rng = random.Random(7)
    legs = [(f"E{i % 30}", f"T{i:03d}", rng.choice(["yes", "no"]), rng.choice([None, *range(8)]), rng.randrange(0, 5)) for i in range(300)]
    got = {r.e: (r.y_t, r.n_t) for r in S.best_ordered_pair(spark.createDataFrame(legs, "e string, t string, side string, strike int, v int"), "e", "side", "strike", "v", "t").collect()}
    # strikes in order, equal ones too, or unknown
    want = {}
    for e in {r[0] for r in legs}:
        pairs = [(-(y[4] + n[4]), y[1], n[1]) for y in legs for n in legs if y[0] == n[0] == e and y[2] == "yes" and n[2] == "no" and (y[3] is None or n[3] is None or y[3] < n[3])]
        if pairs:
            want[e] = min(pairs)[1:]
    assert got == want


def test_track(spark):
    t = spark.createDataFrame([(1, "a", 49, 1, 0.02, True), (2, "a", -451, 2, 0.02, False)], "id int, series string, pnl int, settled_us long, edge double, won boolean")
    assert [r.drawdown for r in T.drawdown(t, ["series"]).orderBy("id").collect()] == [0, 451]
    many = lambda wins: spark.createDataFrame([(i, "a", i, 0.02, i < wins) for i in range(50)], "id int, series string, settled_us long, edge double, won boolean")
    last = lambda df: T.decayed(df, ["series"]).orderBy(F.col("id").desc()).first().paused
    assert last(many(47)) is False and last(many(35)) is True
    assert last(many(35).where("id < 10")) is False


def test_splice_precedence(spark):
    row = lambda *r: spark.createDataFrame([r], "k int, origin string, v int")
    for old, new, want in ((("live", 1), ("historical", 2), 2), (("historical", 1), ("historical", 2), 1), (("historical", 1), ("live", 2), 1)):
        got = K.splice(row(1, *old), row(1, *new), ["k"], "origin").collect()
        assert [r.v for r in got] == [want]
        # a tie that would put the new row first changes nothing between a stored row and a new one
        tied = K.splice(row(1, *old), row(1, *new), ["k"], "origin", F.col("v").desc()).collect()
        assert [r.v for r in tied] == [want]
    assert [r.v for r in K.splice(row(1, "live", 1), row(1, "live", 2), ["k"], "origin", F.col("v").desc()).collect()] == [1]
    fresh = K.insert_new(row(1, "live", 1), row(1, "live", 2).union(row(2, "live", 3)).union(row(2, "live", 4)), ["k"], F.col("v").desc())
    assert [(r.k, r.v) for r in fresh.collect()] == [(2, 4)]
    up = K.overwrite_upsert(row(1, "a", 1).union(row(3, "a", 3)), row(1, "b", 9).union(row(2, "b", 2)), ["k"], keep=["origin"])
    assert sorted(map(tuple, up.collect())) == [(1, "a", 9), (2, "b", 2), (3, "a", 3)]


def test_publish_and_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        K.publish(spark.range(n), path)
        assert K.published(spark, path).count() == n
    assert K.published(spark, str(tmp_path / "none")) is None
    sides = str(tmp_path / "s")
    K.overwrite_partitions(spark.createDataFrame([(1, "yes"), (2, "no")], "v int, side string"), sides, "side")
    K.overwrite_partitions(spark.createDataFrame([(9, "no")], "v int, side string"), sides, "side")
    assert sorted(r.v for r in spark.read.parquet(sides).collect()) == [1, 9]


def test_simulated_totals_repeat(spark):
    t = spark.createDataFrame([(i, 0.9, 10, 90) for i in range(50)], "id int, p double, gain int, loss int")
    a, b = (sorted(r.total for r in T.simulated_totals(t, 200).collect()) for _ in range(2))
    assert a == b and abs(sum(a) / 200) < 30


def test_event_rates_take_a_null_as_a_key_like_any_other(spark):
    rows = [(f"t{i % 90}", "p", None if i < 300 else 7.0 * (i % 50), i % 3 == 0, "snapshot", i, i, 0.42) for i in range(900)]
    obs = spark.createDataFrame(rows, "ticker string, gp string, hours double, yes boolean, source string, period_us long, seq long, price double")
    found = [C.event_rates(obs.withColumn("topic", topic.cast("string")), "price").drop("topic").orderBy("bucket_index").collect() for topic in (F.lit(None), F.lit("x"))]
    assert found[0] == found[1]
    assert sum(r.n for r in found[0]) == 900 and [r.n for r in found[0]] == [300, 300, 300]
    assert found[0][0].hours_to is None


def test_flow_fallback_keeps_orders_that_are_alike_and_nulls(spark):
    def table(level, time, side, vol, price, outcome, n, n_outcome, p):
        return (level, "g", "t", time, side, vol, price, outcome, n_outcome, [p] * 8, n)

    rows = [table(1, "1-3h", "yes", "low", "90", o, 400, 200, p) for o, p in (("won", 0.6), ("lost", 0.5))]
    t = spark.createDataFrame(rows, "level int, gp string, topic string, time_bucket string, side string, vol_bucket string, price string, outcome string, n_outcome long, exceed array<double>, n_observations long")
    schema = "gp string, topic string, hours double, side string, quantity int, limit int, volume int, level_ string, _k string"
    orders = spark.createDataFrame([("g", "t", 2.0, "yes", 1, 90, 50, "a", "b")] * 3 + [(None, "t", 2.0, "yes", 1, 90, 50, None, None), ("g", "t", None, None, None, None, None, None, None)], schema).withColumnRenamed("level_", "k_time")
    got = sorted(((r.gp, r.hours, r.k_time, r.level, r.p_won, r.p_lost) for r in W.fill_probability(orders, t).collect()), key=str)
    assert got == sorted([("g", 2.0, "a", 1, 0.6, 0.5)] * 3 + [(None, 2.0, None, None, None, None), ("g", None, None, None, None, None)], key=str)
    assert W.fill_probability(orders.limit(0), t).count() == 0
    assert [r.level for r in W.fill_probability(orders, t.limit(0)).collect()] == [None] * 5


def test_flow_between_keeps_points_that_are_alike(spark):
    tape = spark.createDataFrame([("t", 5, 1, 80, "no", 3), ("t", 10, 2, 90, "no", 4), ("t", 20, 3, 91, "no", 9)], "ticker string, ts_us long, trade_id int, yes_cents int, taker_side string, count int")
    points = spark.createDataFrame([("t", "yes", 90, 4, 20, 1), ("t", "yes", 90, 4, 20, 1), ("t", "yes", 90, 5, 20, None), ("t", "yes", 90, 30, 20, 2), ("u", "yes", 90, 4, 20, 1)], "ticker string, side string, limit int, from_us long, to_us long, flow_ int")
    got = sorted((r.ticker, r.from_us, r.flow_, r.flow) for r in W.flow_between(points, tape).collect())
    assert got == [("t", 4, 1, 7), ("t", 4, 1, 7), ("t", 5, None, 4), ("t", 30, 2, 0), ("u", 4, 1, 0)]
    assert W.flow_between(points.limit(0), tape).count() == 0


def test_candle_fill_totals_against_single_fills(spark):
    rng = random.Random(11)
    candles = [(t, rng.randint(0, 60), k, rng.choice([None, 0, 3, 15, 40]), (b := rng.randint(1, 90)), b + rng.randint(1, 9), rng.choice([None, 0, b]), rng.choice([None, 0, b])) for k, t in enumerate("aaabb" * 40)]
    orders = [(i, rng.choice("abc"), rng.choice(["yes", "no"]), rng.choice([20, 50, 80]), rng.choice([1, 7, 40, 500]), (p := rng.randint(0, 60)), p + rng.randint(-3, 40)) for i in range(120)]
    c = spark.createDataFrame(candles, "ticker string, period_us long, seq int, volume int, bid_high int, ask_low int, price_high int, price_low int")
    o = spark.createDataFrame(orders, "order_id int, ticker string, side string, limit int, quantity int, placed_us long, end_us long")
    single = {r.order_id: (r.filled, r.first) for r in V.candle_fills(o, c, 0.3, 2).groupBy("order_id").agg(F.sum("fill").alias("filled"), F.min("period_us").alias("first")).collect()}
    got = {r.order_id: (r.filled, r.first_us) for r in V.candle_fill_totals(o, c, 0.3, 2).collect()}
    assert got == {i: single.get(i, (0, None)) for i, *_ in orders} and len(single) > 40
    twice = V.candle_fill_totals(o.unionByName(o), c, 0.3, 2).collect()
    assert sorted(r.order_id for r in twice) == sorted(2 * [i for i, *_ in orders]) and {r.order_id: (r.filled, r.first_us) for r in twice} == got
    none = V.candle_fill_totals(o.withColumn("quantity", F.lit(None).cast("int")), c).collect()
    assert len(none) == 120 and all((r.filled, r.share, r.first_us) == (0, None, None) for r in none)
    assert V.candle_fill_totals(o, c.limit(0)).agg(F.sum("filled")).first()[0] == 0 and V.candle_fill_totals(o.limit(0), c).count() == 0


def test_offers_do_not_search_open_orders(spark):
    """20,000 offers that meet 4,000 open orders, one of each event, none of which settles at once."""
    account = S._Account("s", 10_000, S.Limits(positions=10_000))
    order = lambda i, at: S._Order(f"e{i}", "yes", 2, 1, 1, at, at, 1_000_000 + i, "yes", 0)
    account.advance(0)
    for i in range(4_000):
        account.offer(f"t{i}", order(i, 0))
    began = time.process_time()
    for at in range(1, 1_001):
        account.advance(at)
        for i in range(20):
            account.offer(f"u{at}-{i}", order(i, at))
    assert len(account.open) == 4_000 and time.process_time() - began < 1
    account.settle(float("inf"))
    assert len(account.trades) == 4_000 and account.cash == 10_000 + 98 * 4_000 and not account.escrow and not account.in_event


def test_ev_scan_weighs_prices_and_not_quotes(spark):
    """No candidate is made from a quote: what quotes are joined with is written before."""
    m = spark.createDataFrame([(f"m{i}", f"e{i}", "g", "t", 30.0, 10 + i % 2, 14, 0.5) for i in range(50)], "ticker string, event_ticker string, gp string, topic string, hours double, bid int, ask int, p_event double")
    f = spark.createDataFrame([("g", "t", "<72h", s, k, 0.9, 0.1) for s in ("yes", "no") for k in range(11)], "gp string, topic string, time_bucket string, side string, step int, rate_won double, rate_lost double")
    out = S.ev_scan(m, f)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "rate_won" in plan and out.count() == 50
