"""Virtual orders: placements over a market's life, their features, what they would have filled, and backtests on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators.flow import flow_between, queue_summary
from tidemark.operators.joins import asof_last, first_of

# Windows of recent volume in minutes, quantities and price offsets of the training grid.
RECENT_MINUTES = {"5m": 5, "30m": 30, "2h": 120}
QUANTITIES = (1, 5, 10, 20, 50)
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)


def lifecycle_points(markets: DataFrame, first: str, close: str, fractions: Sequence[float]) -> DataFrame:
    """Times at fractions of a market's life."""
    points = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    return markets.withColumn("fraction", points).withColumn("at_us", (F.col(first) + F.floor((F.col(close) - F.col(first)) * F.col("fraction"))).cast("bigint"))


def lifecycle_quotes(markets: DataFrame, quotes: DataFrame, fractions: Sequence[float], values: Sequence[str]) -> DataFrame:
    """The last quote at or before each point; points with one quote in common count once, the earliest stays."""
    points = lifecycle_points(markets, "first_us", "close_us", fractions)
    found = asof_last(points, quotes, "ticker", "at_us", "period_us", list(values), strict=False, tie=["seq"]).where("matched_at IS NOT NULL")
    return first_of(found, ["ticker", "matched_at"], F.col("fraction"))


def book_features(yes: Column, no: Column, side: Column, limit: Column) -> dict[str, Column]:
    """Ahead of, better than, and the gap to a limit, from ladders of struct(price, quantity)."""
    own = F.when(side == "yes", yes).otherwise(no)
    total = lambda f: F.aggregate(F.filter(own, f), F.lit(0).cast("bigint"), lambda s, x: s + x["quantity"])
    return {
        "at_limit": total(lambda x: x["price"] == limit),
        "better": total(lambda x: x["price"] > limit),
        "depth": total(lambda x: F.lit(True)),
        "gap": F.array_min(F.transform(own, lambda x: F.abs(x["price"] - limit))),
    }


def recent_volume(tape: DataFrame, orders: DataFrame, minutes: dict[str, int] = RECENT_MINUTES) -> DataFrame:
    """Orders (order_id, ticker, placed_us) with the volume of [placed - window, placed) for each window, in one pass."""
    prints = tape.select("ticker", F.col("ts_us").alias("at"), F.col("count").alias("v"))
    rows = orders.select("ticker", F.col("placed_us").alias("at"), F.lit(0).alias("v"), F.struct(*orders.columns).alias("row"))
    frame = lambda m: Window.partitionBy("ticker").orderBy("at").rangeBetween(-m * 60_000_000, -1)
    both = prints.unionByName(rows, allowMissingColumns=True)
    return both.select("row", *[F.coalesce(F.sum("v").over(frame(m)), F.lit(0)).alias(f"volume_{n}") for n, m in minutes.items()]).where("row IS NOT NULL").select("row.*", *[f"volume_{n}" for n in minutes])


def model_features(orders: DataFrame) -> DataFrame:
    """Logarithms, size ratio, hour and weekday (Monday 0) of orders with placed_us, quantity, depth and volume columns."""
    at = F.timestamp_micros("placed_us")
    logs = [F.log1p(F.col(c)).alias(f"log_{c}") for c in orders.columns if c.startswith("volume_") or c in ("quantity", "depth")]
    return orders.select("*", *logs, F.try_divide(F.col("quantity"), F.col("depth") + 1).alias("size_ratio"), F.hour(at).alias("hour"), F.weekday(at).alias("weekday"))


def training_grid(quotes: DataFrame, offsets: Sequence[int] = OFFSETS, quantities: Sequence[int] = QUANTITIES, legacy: bool = False) -> DataFrame:
    """Orders on both sides at price offsets from the best bid and several quantities, limits within 1-99.

    NO orders start from the best NO bid, 100 less the ask; legacy starts them from 100 less the ask in YES terms as older data have it.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(o).alias("offset")) for s in ("yes", "no") for o in offsets]))
    sided = quotes.withColumn("c", cells).select("*", "c.*").drop("c")
    base = F.when(F.col("side") == "yes", F.col("bid")).otherwise(F.col("ask") if legacy else 100 - F.col("ask"))
    placed = sided.withColumn("limit", base + F.col("offset")).where(F.col("limit").between(1, 99))
    return placed.withColumn("quantity", F.explode(F.array(*[F.lit(q) for q in quantities])))


def virtual_orders(orders: DataFrame, tape: DataFrame) -> DataFrame:
    """Orders (what queue_summary takes, and depth) with recent volumes, features and the outcome of the queue. An order_id is one order."""
    done = queue_summary(orders, tape)
    return model_features(recent_volume(tape, orders)).join(done, "order_id")


def candle_fills(orders: DataFrame, candles: DataFrame, rate: float = 0.1, least: int = 1) -> DataFrame:
    """Contracts that each later candle fills of an order: touched ones give a share of their volume until the quantity is reached."""
    near = orders.join(candles, "ticker").where("period_us > placed_us AND period_us < end_us")
    hit = X.touched(F.col("side"), F.col("limit"), F.col("bid_high"), F.col("ask_low"), F.col("price_high"), F.col("price_low"))
    offered = F.when(hit, X.fillable(F.col("volume"), F.col("quantity"), rate, least)).otherwise(0)
    run = Window.partitionBy("order_id").orderBy("period_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    summed = near.withColumn("o", offered).withColumn("upto", F.sum("o").over(run))
    return summed.withColumn("fill", F.least("quantity", "upto") - F.least(F.col("quantity"), F.col("upto") - F.col("o"))).where("fill > 0").select("order_id", "period_us", "seq", "fill")


def candle_fill_totals(orders: DataFrame, candles: DataFrame, rate: float = 0.1, least: int = 1) -> DataFrame:
    """M03, W19 without the single fills: order_id, filled, share, first_us (period of the first fill) of every order, from running sums; no candle meets an order.

    What a candle offers doesn't depend on the order's quantity until the quantity is reached, so the contracts that all
    candles before a time offer at a limit are one running sum for each (ticker, side, limit) in use, candles being taken
    once for each of these. An order's fill is the difference between its two ends, its quantity at most; the first is at the
    next candle that offers anything. Candles at either end don't count. Quantities of null or less than one fill nothing; a
    repeated order_id gives a row each.
    """
    key, at = ["ticker", "side", "limit"], ["t", "kind"]
    met = candles.join(orders.select(*key).distinct(), "ticker")
    hit = X.touched(F.col("side"), F.col("limit"), F.col("bid_high"), F.col("ask_low"), F.col("price_high"), F.col("price_low"))
    offered = F.when(F.col("volume") > 0, F.greatest(F.floor(F.col("volume") * rate).cast("long"), F.lit(least).cast("long")))
    prints = met.where(hit & (offered > 0)).select(*key, F.col("period_us").alias("t"), F.lit(1).alias("kind"), offered.alias("v"))
    # at one time: the end of an order, then candles, then the begin of an order
    ends = F.explode(F.array(F.struct(F.col("placed_us").alias("t"), F.lit(2).alias("kind")), F.struct(F.col("end_us").alias("t"), F.lit(0).alias("kind"))))
    order = F.struct("order_id", "quantity", "placed_us", "end_us")
    asked = orders.select(*key, order.alias("order"), ends.alias("e")).select(*key, "e.t", "e.kind", F.lit(0).cast("long").alias("v"), "order")
    by_time = Window.partitionBy(*key).orderBy(*at)
    upto, onward = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_time.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    summed = prints.unionByName(asked, allowMissingColumns=True).withColumn("sum", F.sum("v").over(upto)).withColumn("next", F.min(F.when(F.col("kind") == 1, F.col("t"))).over(onward)).where("kind <> 1")
    begin = F.struct("sum", "next")
    both = summed.groupBy(*key, "order").agg(F.max(F.when(F.col("kind") == 2, begin)).alias("lo"), F.max(F.when(F.col("kind") == 0, F.col("sum"))).alias("hi"), F.count_if(F.col("kind") == 0).cast("int").alias("alike"))
    quantity = F.coalesce(F.greatest(F.lit(0), F.col("order.quantity")), F.lit(0))
    filled = F.least(quantity, F.greatest(F.lit(0).cast("long"), F.col("hi") - F.col("lo.sum")))
    each = both.select("order.order_id", filled.alias("filled"), F.try_divide(filled, quantity).alias("share"), F.when(filled > 0, F.col("lo.next")).alias("first_us"), F.explode(F.array_repeat(F.lit(0), F.col("alike"))))
    return each.drop("col")


def first_tail_backtest(candles: DataFrame, settled: DataFrame, contracts: int = 1) -> DataFrame:
    """Of each market the first candle with a tail before settlement, bought at the mid, and its pnl."""
    rows = candles.join(settled.where("result IS NOT NULL"), "ticker").where("period_us < settled_us")
    tails = rows.select("ticker", "period_us", "seq", "result", "settled_us", F.explode(X.tails(F.col("bid"), F.col("ask"))).alias("t")).select("*", "t.*")
    first = first_of(tails, ["ticker"], F.col("period_us"), F.col("seq"))
    won = F.col("result") == F.col("side")
    return first.select("ticker", "side", F.col("mid").alias("entry"), won.alias("won"), X.pnl(F.col("mid"), F.when(won, 100).otherwise(0), F.lit(contracts), X.fee(F.col("mid"), F.lit(contracts))).alias("pnl"))


def gbt_training_rows(candles: DataFrame, tape: DataFrame, quantities: Sequence[int] = QUANTITIES, steps: int = 10) -> DataFrame:
    """For each candle, side and step, whether the opposing flow to settlement reaches 0.3 of the open interest plus each quantity: conditional columns, not rows."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(i).alias("step")) for s in ("yes", "no") for i in range(steps + 1)]))
    grid = candles.select("*", sides.alias("c")).select("*", "c.*").drop("c")
    low = F.when(F.col("side") == "yes", F.col("bid")).otherwise(100 - F.col("ask"))
    placed = grid.withColumn("limit", X.limit_at(low, low + F.col("ask") - F.col("bid"), F.col("step") / F.lit(float(steps))))
    joined = flow_between(placed.withColumn("from_us", F.col("period_us")).withColumn("to_us", F.col("settled_us")), tape)
    return joined.select("ticker", "period_us", "side", "step", "limit", "flow", *[(F.col("flow") >= 0.3 * F.col("open_interest") + q).alias(f"filled_{q}") for q in quantities])
