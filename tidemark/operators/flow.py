"""Order flow: opposing flow after hypothetical placements, exceedance tables with fallbacks, and queue positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
# Flow thresholds, limits of virtual orders, support that a table entry needs.
THRESHOLDS = [1, 5, 10, 20, 50, 100, 200, 500]
LIMITS = list(range(85, 98))
LEAST_COMBINED, LEAST_OUTCOME = 200, 50


def trailing_volume(tape: DataFrame, at: DataFrame, window_us: int = DAY_US, both_ends: bool = False) -> DataFrame:
    """`at` (ticker, at_us) with the volume of its ticker in [at - window, at), or to at itself."""
    prints = tape.select("ticker", F.col("ts_us").alias("at_us"), F.col("count").alias("v"), F.lit(None).cast("struct<x:int>").alias("row"))
    rows = at.select("ticker", "at_us", F.lit(0).alias("v"), F.struct(*at.columns).alias("row"))
    frame = Window.partitionBy("ticker").orderBy("at_us").rangeBetween(-window_us, 0 if both_ends else -1)
    summed = prints.drop("row").unionByName(rows, allowMissingColumns=True).withColumn("volume", F.coalesce(F.sum("v").over(frame), F.lit(0)))
    return summed.where("row IS NOT NULL").select("row.*", "volume")


def placements(tape: DataFrame, markets: DataFrame, every_us: int = HOUR_US) -> DataFrame:
    """Times from a market's first print on, every so often, before it settles."""
    first = tape.groupBy("ticker").agg(F.min("ts_us").alias("first_us"))
    return markets.join(first, "ticker").where("first_us < settled_us").withColumn("at_us", F.explode(F.sequence(F.col("first_us"), F.col("settled_us") - 1, F.lit(every_us))))


def flow_observations(tape: DataFrame, markets: DataFrame, limits: Sequence[int] = LIMITS) -> DataFrame:
    """C08, first half: a row for each placement, side and limit, with the opposing flow from the placement (not at it) to settlement.

    Running sums of all sides and limits share one window over prints and placements of a market; the flow is the
    market's total less the sum so far (W08, W09). A placement carries what is known of its market, so that the rows for each
    side and limit are neither joined nor shuffled.
    """
    points = placements(tape, markets)
    before = tape.join(markets.select("ticker", "settled_us"), "ticker").where("ts_us < settled_us")
    names = {(s, p): f"{s}_{p}" for s in ("yes", "no") for p in limits}
    flows = [X.opposing_flow(F.lit(s), F.lit(p), F.col("yes_cents"), F.col("taker_side"), F.col("count")).alias(n) for (s, p), n in names.items()]
    prints = before.select("ticker", F.col("ts_us").alias("at_us"), F.lit(False).alias("placed"), F.col("count").alias("v"), *flows)
    rows = points.select("ticker", "at_us", F.lit(True).alias("placed"), F.lit(0).alias("v"), *[F.lit(0).alias(n) for n in names.values()], "settled_us", "gp", "topic", "result")
    both = prints.unionByName(rows, allowMissingColumns=True)
    # prints at the time of a placement count as before it, so the frame of equal times ends the running sum
    so_far, whole = Window.partitionBy("ticker").orderBy("at_us").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("ticker")
    day = Window.partitionBy("ticker").orderBy("at_us").rangeBetween(-DAY_US, -1)
    left = both.select("at_us", "placed", "settled_us", "gp", "topic", "result", F.coalesce(F.sum("v").over(day), F.lit(0)).alias("volume"), *[(F.sum(n).over(whole) - F.sum(n).over(so_far)).alias(n) for n in names.values()]).where("placed")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(p).alias("price"), F.col(n).alias("flow")) for (s, p), n in names.items()]))
    tall = left.select("at_us", "settled_us", "gp", "topic", "result", "volume", each.alias("o")).select("*", "o.*")
    hours = (F.col("settled_us") - F.col("at_us")) / F.lit(3.6e9)
    outcome = F.when(F.col("result") == F.col("side"), "won").otherwise("lost")
    return tall.select("gp", "topic", X.flow_time_bucket(hours).alias("time_bucket"), "side", X.volume_bucket(F.col("volume")).alias("vol_bucket"), "price", outcome.alias("outcome"), "flow")


def flow_table(obs: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """C08, second half; A18, A19: exceedances of each key at six levels, each with its rows and those of its key without the outcome.

    Counts add up, so the levels are grouping sets over counts by the finest key, not over observations.
    """
    over = [f"over_{t}" for t in thresholds]
    fine = obs.withColumn("coarse", X.coarse_time_bucket(F.col("time_bucket"))).groupBy("gp", "topic", "time_bucket", "coarse", "side", "vol_bucket", "price", "outcome").agg(F.count("*").alias("n"), *[F.count_if(F.col("flow") >= t).alias(o) for t, o in zip(thresholds, over, strict=True)])
    sets = [
        ("gp", "topic", "time_bucket", "side", "vol_bucket", "price", "outcome"),
        ("gp", "topic", "time_bucket", "side", "price", "outcome"),
        ("gp", "topic", "coarse", "side", "price", "outcome"),
        ("gp", "topic", "coarse", "side", "outcome"),
        ("gp", "topic", "coarse", "side"),
        ("gp", "topic", "coarse"),
    ]
    every = ["gp", "topic", "time_bucket", "coarse", "side", "vol_bucket", "price", "outcome"]
    grouped = fine.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(F.grouping_id(*every).alias("gid"), F.sum("n").alias("n_outcome"), *[F.sum(o).alias(o) for o in over])
    number = {sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in s): k for k, s in enumerate(sets, 1)}
    level = F.element_at(F.create_map(*[F.lit(int(x)) for p in number.items() for x in p]), F.col("gid").cast("int"))
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    keyed = grouped.select(level.alias("level"), "gp", "topic", F.coalesce("time_bucket", "coarse").alias("time_bucket"), *[star(c).alias(c) for c in ("side", "vol_bucket", "price", "outcome")], "n_outcome", F.array(*[F.col(o) / F.col("n_outcome") for o in over]).alias("exceed"))
    parent = Window.partitionBy("level", "gp", "topic", "time_bucket", "side", "vol_bucket", "price")
    return keyed.withColumn("n_observations", F.sum("n_outcome").over(parent))


def fill_probability(orders: DataFrame, table: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Orders (gp, topic, hours, side, quantity, limit, volume) with level, p_won and p_lost of the first level with enough support; nulls if none has.

    Levels are tried once for each key in use, of which a (gp, topic) has some 900 at most, and orders then take the curves
    of their key: an order is neither numbered nor repeated, so orders that are alike all stay.
    """
    fine = X.flow_time_bucket(F.col("hours"))
    names = ["k_time", "k_side", "k_vol", "k_price"]
    own = [f"_{n}" for n in ("gp", "topic", *names)]
    mine = {"_gp": F.col("gp"), "_topic": F.col("topic"), "_k_time": fine, "_k_side": F.col("side"), "_k_vol": X.volume_bucket(F.col("volume")), "_k_price": X.snap_tail(F.col("limit")).cast("string")}
    keyed = orders.select("*", *[c.alias(n) for n, c in mine.items()])
    time, side, vol, price = (F.col(n) for n in own[2:])
    coarse, any_ = X.coarse_time_bucket(time), F.lit("*")
    tries = [(time, side, vol, price), (time, side, any_, price), (coarse, side, any_, price), (coarse, side, any_, any_), (coarse, side, any_, any_), (coarse, any_, any_, any_)]
    tried = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), *[c.alias(n) for n, c in zip(names, t, strict=True)]) for i, t in enumerate(tries, 1)]))
    candidates = keyed.select(*own).distinct().select(*own, F.col("_gp").alias("gp"), F.col("_topic").alias("topic"), tried.alias("t")).select(*own, "gp", "topic", "t.*")
    curve = F.struct("exceed", "n_observations", "n_outcome")
    pairs = table.groupBy("level", "gp", "topic", F.col("time_bucket").alias("k_time"), F.col("side").alias("k_side"), F.col("vol_bucket").alias("k_vol"), F.col("price").alias("k_price")).agg(
        *[F.max(F.when(F.col("outcome") == o, curve)).alias(a) for o, a in (("won", "w"), ("lost", "l"), ("*", "m"))]
    )
    enough = F.when(F.col("level") <= 4, (F.col("w.n_observations") >= LEAST_COMBINED) & (F.col("w.n_outcome") >= LEAST_OUTCOME) & (F.col("l.n_outcome") >= LEAST_OUTCOME)).otherwise(F.col("m.n_observations") >= LEAST_COMBINED)
    split = F.col("level") <= 4
    found = candidates.join(pairs.where(enough), ["level", "gp", "topic", *names]).groupBy(*own).agg(F.min_by(F.struct("level", F.when(split, F.col("w")).otherwise(F.col("m")).alias("w"), F.when(split, F.col("l")).otherwise(F.col("m")).alias("l")), "level").alias("_best"))
    known = found.select(*[F.col(n).alias(f"_f{n}") for n in own], "_best")
    joined = keyed.join(known, [F.col(n).eqNullSafe(F.col(f"_f{n}")) for n in own], "left")
    at = F.array(*[F.lit(t) for t in thresholds])
    p = lambda c: F.when(F.col("_best").isNotNull(), X.cdf_lookup(at, F.col(f"_best.{c}.exceed"), F.col("quantity"), F.col(f"_best.{c}.n_observations")))
    return joined.select(*orders.columns, F.col("_best.level").alias("level"), p("w").alias("p_won"), p("l").alias("p_lost"))


def _levels(tape: DataFrame, keys: DataFrame) -> DataFrame:
    """Prints of each (ticker, side, limit) that they reach: v at the limit or past it, at the part of it at the limit itself. Prints times the limits in use of their ticker, 198 at most, whatever the number of orders."""
    met = tape.select("ticker", "ts_us", "trade_id", "yes_cents", "taker_side", "count").join(keys.select("ticker", "side", "limit").distinct(), "ticker")
    price = F.when(F.col("side") == "yes", F.col("yes_cents")).otherwise(100 - F.col("yes_cents"))
    hit = met.withColumn("v", X.opposing_flow(F.col("side"), F.col("limit"), F.col("yes_cents"), F.col("taker_side"), F.col("count"))).where("v > 0")
    return hit.select("ticker", "side", "limit", "ts_us", "trade_id", "v", F.when(price == F.col("limit"), F.col("v")).otherwise(0).alias("at"))


def flow_between(points: DataFrame, tape: DataFrame) -> DataFrame:
    """points (ticker, side, limit, from_us, to_us, ...) with the opposing flow strictly between the two times, from running sums: no print meets a point.

    Points that are alike in all columns are one while they are summed, and as many as they were in the result.
    """
    sums = Window.partitionBy("ticker", "side", "limit").orderBy("t", "kind")
    prints = _levels(tape, points).select("ticker", "side", "limit", F.col("ts_us").alias("t"), F.lit(1).alias("kind"), "v")
    # at one time: the end of a point, then prints, then the begin of a point
    ends = F.explode(F.array(F.struct(F.col("from_us").alias("t"), F.lit(2).alias("kind")), F.struct(F.col("to_us").alias("t"), F.lit(0).alias("kind"))))
    asked = points.select("ticker", "side", "limit", F.struct(*points.columns).alias("point"), ends.alias("e")).select("ticker", "side", "limit", "e.t", "e.kind", F.lit(0).alias("v"), "point")
    seen = prints.unionByName(asked, allowMissingColumns=True).withColumn("sum", F.sum("v").over(sums.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("kind <> 1")
    both = seen.groupBy("ticker", "side", "limit", "point").agg(F.max(F.when(F.col("kind") == 0, F.col("sum"))).alias("hi"), F.max(F.when(F.col("kind") == 2, F.col("sum"))).alias("lo"), F.count_if(F.col("kind") == 0).cast("int").alias("alike"))
    each = both.select("point", F.greatest(F.lit(0).cast("long"), F.col("hi") - F.col("lo")).alias("flow"), F.explode(F.array_repeat(F.lit(0), F.col("alike"))))
    return each.select("point.*", "flow")


def queue_summary(orders: DataFrame, tape: DataFrame) -> DataFrame:
    """M05, Q41 without the single fills: order_id, filled, share, all_filled, first_s of every order, from running sums.

    At the limit prints first serve the queue; from the first print past the limit on all opposing flow is the order's. With
    A the running flow at the limit and B all opposing flow of (ticker, side, limit), an order needs both where it begins and
    where it ends, and both before the first print past the limit in between; the first fill is there, or at the first
    print where A exceeds what it was by more than the queue. Each is a running value over one sorted group.
    """
    key = ["ticker", "side", "limit"]
    point = F.struct("order_id", "quantity", "ahead", "placed_us", "end_us")
    prints = _levels(tape, orders).select(*key, F.col("ts_us").alias("t"), F.lit(1).alias("kind"), F.col("trade_id").alias("tie"), "v", "at")
    ends = F.explode(F.array(F.struct(F.col("placed_us").alias("t"), F.lit(0).alias("kind")), F.struct(F.col("end_us").alias("t"), F.lit(2).alias("kind"))))
    asked = orders.select(*key, point.alias("order"), ends.alias("e")).select(*key, "e.t", "e.kind", F.lit(0).alias("v"), F.lit(0).alias("at"), "order")
    rows = prints.unionByName(asked, allowMissingColumns=True)
    by_time = Window.partitionBy(*key).orderBy("t", "kind", "tie")
    upto, onward = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_time.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    summed = rows.withColumn("A", F.sum("at").over(upto)).withColumn("B", F.sum("v").over(upto))
    past = F.when((F.col("kind") == 1) & (F.col("v") > F.col("at")), F.struct("t", "A", (F.col("B") - F.col("v")).alias("B")))
    swept = summed.withColumn("sweep", F.first(past, ignorenulls=True).over(onward))
    # the first print where A is over a value: prints and orders on one axis, the next print's time is the least of those after
    at_limit = swept.where("kind = 1 AND at > 0").select(*key, F.col("A").alias("x"), F.lit(1).alias("kind"), "t")
    wanted = swept.where("kind = 0").select(*key, (F.col("A") + F.col("order.ahead")).alias("x"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("t"), F.col("order.order_id").alias("_id"))
    after = Window.partitionBy(*key).orderBy("x", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    served = at_limit.unionByName(wanted, allowMissingColumns=True).withColumn("served", F.first("t", ignorenulls=True).over(after)).where("kind = 2").select(*key, "_id", "served")
    # what is known of an order meets by its key and order_id, which is one an order, in the task that has the key
    state = F.struct("A", "B", "sweep")
    known = swept.where("kind <> 1").select(*key, F.col("order.order_id").alias("_id"), F.when(F.col("kind") == 0, F.col("order")).alias("order"), F.when(F.col("kind") == 0, state).alias("a"), F.when(F.col("kind") == 2, state).alias("b"))
    both = known.unionByName(served, allowMissingColumns=True).groupBy(*key, "_id").agg(*[F.max(c).alias(c) for c in ("order", "a", "b", "served")])
    ahead, quantity = F.col("order.ahead"), F.col("order.quantity")
    hit = F.col("a.sweep").isNotNull() & (F.col("a.sweep.t") <= F.col("order.end_us"))
    at_end = F.when(hit, F.col("a.sweep.A")).otherwise(F.col("b.A"))
    free = F.when(hit, F.col("b.B") - F.col("a.sweep.B")).otherwise(0)
    filled = F.least(quantity, F.greatest(F.lit(0).cast("long"), at_end - F.col("a.A") - ahead) + free)
    first = F.least(F.when(hit, F.col("a.sweep.t")), F.col("served"))
    out = both.select("order.order_id", filled.alias("filled"), quantity.alias("quantity"), F.when(filled > 0, (first - F.col("order.placed_us")) / F.lit(1e6)).alias("first_s"))
    return out.select("order_id", "filled", (F.col("filled") / F.col("quantity")).alias("share"), (F.col("filled") == F.col("quantity")).alias("all_filled"), "first_s")


def queue_fills(orders: DataFrame, tape: DataFrame) -> DataFrame:
    """What each print from placed_us to end_us (both included) fills of an order with others queued ahead.

    orders: order_id, ticker, side, limit, quantity, ahead, placed_us, end_us. Prints at the limit first serve the queue;
    from the first print past the limit on, all opposing flow is the order's. Both parts are running sums.
    """
    near = orders.join(tape.select("ticker", "ts_us", "trade_id", "yes_cents", "taker_side", "count"), "ticker").where("ts_us BETWEEN placed_us AND end_us")
    flow = X.opposing_flow(F.col("side"), F.col("limit"), F.col("yes_cents"), F.col("taker_side"), F.col("count"))
    past = F.when(F.col("side") == "yes", F.col("yes_cents") < F.col("limit")).otherwise(100 - F.col("yes_cents") < F.col("limit"))
    hits = near.withColumn("v", flow).where("v > 0").withColumn("past", past)
    so_far = Window.partitionBy("order_id").orderBy("ts_us", "trade_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = hits.withColumn("swept", F.max(F.col("past").cast("int")).over(so_far) == 1)
    summed = swept.withColumn("_before", F.sum(F.when(~F.col("swept"), F.col("v")).otherwise(0)).over(so_far)).withColumn("_after", F.sum(F.when(F.col("swept"), F.col("v")).otherwise(0)).over(so_far))
    filled = summed.withColumn("filled", F.least(F.col("quantity"), F.greatest(F.lit(0), F.col("_before") - F.col("ahead")) + F.col("_after")))
    step = F.col("filled") - F.coalesce(F.lag("filled").over(Window.partitionBy("order_id").orderBy("ts_us", "trade_id")), F.lit(0))
    return filled.withColumn("fill", step).where("fill > 0").select("order_id", "ts_us", "trade_id", "fill", "filled", "quantity", "placed_us")


def tape_fills(orders: DataFrame, tape: DataFrame) -> DataFrame:
    """Fills by opposing flow strictly between placement and end, without a queue."""
    strict = orders.withColumn("ahead", F.lit(0)).withColumn("placed_us", F.col("placed_us") + 1).withColumn("end_us", F.col("end_us") - 1)
    return queue_fills(strict, tape).withColumn("placed_us", F.col("placed_us") - 1)


def fill_summary(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Q41: filled contracts, share, whether all, and seconds to the first fill of each order."""
    done = fills.groupBy("order_id").agg(F.sum("fill").alias("_filled"), F.min("ts_us").alias("_first"))
    joined = orders.join(done, "order_id", "left")
    filled = F.coalesce("_filled", F.lit(0))
    return joined.select("order_id", filled.alias("filled"), (filled / F.col("quantity")).alias("share"), (filled == F.col("quantity")).alias("all_filled"), ((F.col("_first") - F.col("placed_us")) / F.lit(1e6)).alias("first_s"))
