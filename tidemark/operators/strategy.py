"""Opportunity scans, pairs, and replay under cash and risk limits."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators.joins import first_of
from tidemark.session import written


def ev_scan(markets: DataFrame, fills: DataFrame, steps: int = 10, most_contracts: int = 5, budget_cents: int = 400) -> DataFrame:
    """Of each event the market, side and limit of the largest total expected value above 0.

    markets: ticker, event_ticker, gp, topic, hours, bid, ask, p_event. fills: gp, topic, time_bucket, side, step, rate_won,
    rate_lost. A ticker has one event. The best order of a quote depends on its cell, prices and p_event only, so candidates
    are rows of the different ones of these, whose number whole cents bound, and not of quotes; what is best of them is
    written, so that Spark knows its size when quotes are joined. Quotes are shuffled once, by event. Ties go to YES, then to
    the smaller step and limit; between markets to the smaller ticker.
    """
    cell = ["gp", "topic", "time_bucket"]
    asked = [*cell, "bid", "ask", "p_event"]
    quotes = markets.where("ask > bid").withColumn("time_bucket", X.fill_time_bucket(F.col("hours")))
    met = quotes.select(*asked).distinct().join(fills.select(*cell, "side", "step", "rate_won", "rate_lost"), cell)
    yes = F.col("side") == "yes"
    low = F.when(yes, F.col("bid")).otherwise(100 - F.col("ask"))
    limit = low + F.bround((F.col("step") / F.lit(float(steps))) * (F.col("ask") - F.col("bid"))).cast("int")
    ev = X.trade_ev(F.col("p_event"), F.col("rate_won"), F.col("rate_lost"), F.col("limit"), F.col("side"), X.fee(F.col("limit"), F.lit(1)))
    candidates = met.withColumn("limit", limit).withColumn("ev", F.round(ev, 9)).where("ev > 0 AND limit > 0")
    order = F.struct("ev", yes.alias("yes"), (-F.col("step")).alias("sooner"), (-F.col("limit")).alias("lower"), "side", "step", "limit", "rate_won", "rate_lost")
    best = written(candidates.groupBy(*asked).agg(F.max(order).alias("_best")), "best_orders")
    rows = quotes.join(best, asked).repartition("event_ticker")
    by_ticker = rows.groupBy("event_ticker", "ticker").agg(F.max_by(F.struct(*rows.columns), "_best").alias("_row")).select("_row.*")
    contracts = F.least(F.lit(most_contracts), F.greatest(F.lit(1), F.floor(F.lit(budget_cents) / F.col("limit")).cast("int")))
    sized = by_ticker.select(*[c for c in rows.columns if c != "_best"], *[f"_best.{c}" for c in ("side", "step", "limit", "rate_won", "rate_lost", "ev")]).withColumn("contracts", contracts).withColumn("total_ev", F.col("ev") * F.col("contracts"))
    return sized.groupBy("event_ticker").agg(F.min_by(F.struct(*sized.columns), F.struct(-F.col("total_ev"), "ticker")).alias("_row")).select("_row.*")


def joint_scan(markets: DataFrame, fills: DataFrame, most_contracts: int = 5, budget_cents: int = 400) -> DataFrame:
    """The same over limits 85-97 and quantities at once, within the budget, by total expected value. fills has p_won and p_lost by gp, topic, side, limit, quantity."""
    known = markets.join(fills, ["gp", "topic"]).where((F.col("quantity") <= most_contracts) & (F.col("limit") * F.col("quantity") <= budget_cents))
    fee_each = X.fee(F.col("limit"), F.col("quantity")) / F.col("quantity")
    total = F.round(X.trade_ev(F.col("p_event"), F.col("p_won"), F.col("p_lost"), F.col("limit"), F.col("side"), fee_each) * F.col("quantity"), 9)
    best = first_of(known.withColumn("total_ev", total).where("total_ev > 0"), ["ticker"], F.col("total_ev").desc(), (F.col("side") == "no"), "limit", "quantity")
    return first_of(best, ["event_ticker"], F.col("total_ev").desc(), F.col("ticker"))


def best_ordered_pair(legs: DataFrame, key: str, side: str, order: str, value: str, name: str) -> DataFrame:
    """Of each key the YES leg and the NO leg of the largest sum of value whose order rises from YES to NO, or is unknown for one of them; name tells legs apart and breaks ties.

    A NO leg's best YES leg is a running maximum over the order, or the best without an order; a NO leg without an order takes
    the best of all. No pair is formed. Ties go to the smaller YES name, then to the smaller NO name.
    """
    leg = F.struct(F.col(value).alias("v"), F.col(name).alias("name"))
    # the largest value, and of those the smallest name: names are ranked once, so that one maximum says both
    ranked = legs.withColumn("_n", -F.row_number().over(Window.partitionBy(key).orderBy(name)))
    best = F.when(F.col(side) == "yes", F.struct(F.col(value).alias("v"), F.col("_n").alias("n"), leg.alias("leg")))
    known = F.col(order).isNotNull()
    up_to = Window.partitionBy(key, known).orderBy(order, (F.col(side) == "yes").cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    met = ranked.select(key, side, name, value, "_n", F.max(F.when(known, best)).over(up_to).alias("_lower"), F.max(F.when(~known, best)).over(whole).alias("_free"), F.max(best).over(whole).alias("_any"), known.alias("_known"))
    yes = F.when(F.col("_known"), F.greatest("_lower", "_free")).otherwise(F.col("_any"))
    pairs = met.where(F.col(side) == "no").withColumn("_yes", yes).where("_yes IS NOT NULL")
    total = F.struct((F.col("_yes.v") + F.col(value)).alias("total"), F.col("_yes.n").alias("yn"), F.col("_n").alias("nn"))
    top = pairs.groupBy(key).agg(F.max_by(F.struct(F.col("_yes.leg").alias("yes"), leg.alias("no")), total).alias("p"))
    return top.select(key, F.col("p.yes.name").alias(f"y_{name}"), F.col("p.no.name").alias(f"n_{name}"), F.col("p.yes.v").alias(f"y_{value}"), F.col("p.no.v").alias(f"n_{value}"))


def tail_pairs(tails: DataFrame, edges: DataFrame, least_edge: float) -> DataFrame:
    """Tails (event_ticker, ticker, side, mid, strike, gp, topic) with enough edge, and of each event the best YES and NO whose strikes are in order or unknown. A ticker has tails on one side only."""
    good = tails.join(edges, ["gp", "topic"]).withColumn("net", F.col("edge") - X.fee(F.col("mid"), F.lit(1)) / 100).where(F.col("net") >= least_edge)
    return best_ordered_pair(good, "event_ticker", "side", "strike", "net", "ticker").withColumn("mean_net", (F.col("y_net") + F.col("n_net")) / 2)


@dataclass(frozen=True)
class Limits:
    """Shares of equity deployed and in one event, and positions at most."""

    deployed: float = 0.80
    event: float = 0.15
    positions: int = 50


TRADES = "scenario string, ticker string, event_ticker string, side string, price int, contracts int, placed_us long, settled_us long, won boolean, fee int, pnl long"


@dataclass
class _Order:
    """An order of a replay between placement and settlement."""

    event_ticker: str
    side: str
    price: int
    contracts: int
    fills: int
    filled_us: int
    placed_us: int
    settled_us: int
    result: str
    fee: int


class _Account:
    """Cash, escrow and open orders of one scenario: all that depends on earlier orders. Its size is bounded by the cash, and the open orders are searched neither by an offer nor by a period."""

    def __init__(self, scenario: str, cash: int, limits: Limits | None):
        self.scenario, self.cash, self.escrow, self.limits = scenario, cash, 0, limits
        self.open: dict[str, _Order] = {}
        self.ends: list[tuple[int, str]] = []
        self.in_event: Counter[str] = Counter()
        self.period: int | None = None
        self.equity, self.may_place = cash, True
        self.trades: list[tuple] = []

    def advance(self, period: int) -> None:
        """A new period: markets settle first; fills of what is left are seen, which counts once a market settles."""
        self.settle(period)
        self.period, self.equity = period, self.cash + self.escrow
        self.may_place = not self.limits or len(self.open) < self.limits.positions

    def settle(self, until: float) -> None:
        while self.ends and self.ends[0][0] <= until:
            _, ticker = heapq.heappop(self.ends)
            o = self.open.pop(ticker)
            # the last period that the order was open in sees its fills, but not the one that placed it
            filled = min(o.fills, o.contracts) if o.placed_us < self.period and o.filled_us <= self.period else 0
            self.escrow -= o.price * o.contracts
            self.in_event[o.event_ticker] -= o.price * o.contracts
            if not self.in_event[o.event_ticker]:
                del self.in_event[o.event_ticker]
            self.cash += o.price * (o.contracts - filled)
            if filled:
                won = o.side == o.result
                self.cash += 100 * filled * won - o.fee
                self.trades.append((self.scenario, ticker, o.event_ticker, o.side, o.price, filled, o.placed_us, o.settled_us, won, o.fee, (100 * won - o.price) * filled - o.fee))

    def offer(self, ticker: str, o: _Order) -> None:
        cost = o.price * o.contracts
        if not self.may_place or ticker in self.open or cost > self.cash or o.settled_us <= o.placed_us:
            return
        if self.limits and (self.escrow + cost > self.limits.deployed * self.equity or self.in_event[o.event_ticker] + cost > self.limits.event * self.equity):
            return
        self.open[ticker] = o
        heapq.heappush(self.ends, (o.settled_us, ticker))
        self.cash, self.escrow = self.cash - cost, self.escrow + cost
        self.in_event[o.event_ticker] += cost


OFFERS = ("scenario", "period_us", "rank", "ticker", "event_ticker", "side", "price", "contracts", "filled", "filled_us", "settled_us", "result", "fee")


def replay(candidates: DataFrame, cash: int = 10_000, limits: Limits | None = None) -> DataFrame:
    """Which candidates each scenario can pay for, and what they return after fees.

    candidates: scenario, period_us, rank, ticker, event_ticker, side, price, contracts, filled (contracts that fill),
    filled_us, settled_us, result. At each period of a scenario markets that have settled pay out first, and what isn't filled
    by then is given back; then fills up to the period are seen, from the first period after the placement on; then offers are
    taken in the order of rank and ticker. A row without a ticker is a period without an offer. What fills after the last
    period doesn't count.

    Fees are computed before, in columns. The rows of a scenario stream through one task in the order of time, and only
    cash and open orders are kept; scenarios run in parallel, so their number should grow with the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account: _Account | None = None
        names = [c.split()[0] for c in TRADES.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
        types = [kinds[c.split()[1]] for c in TRADES.split(", ")]
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        def close() -> None:
            if account:
                account.settle(float("inf"))
                out.extend(account.trades)

        for batch in batches:
            for row in batch.to_pylist():
                if account is None or account.scenario != row["scenario"]:
                    close()
                    account = _Account(row["scenario"], cash, limits)
                if account.period != row["period_us"]:
                    account.advance(row["period_us"])
                if row["ticker"] is not None:
                    account.offer(row["ticker"], _Order(row["event_ticker"], row["side"], row["price"], row["contracts"], row["filled"], row["filled_us"], row["period_us"], row["settled_us"], row["result"], row["fee"]))
            if account:
                out.extend(account.trades)
                account.trades.clear()
            if len(out) > 10_000:
                yield rows()
                out.clear()
        close()
        if out:
            yield rows()

    done = F.least(F.col("filled"), F.col("contracts"))
    priced = candidates.withColumn("fee", X.fee(F.col("price"), done)).select(*OFFERS)
    return priced.repartition("scenario").sortWithinPartitions("scenario", "period_us", "rank", "ticker").mapInArrow(run, TRADES)


def bernoulli_fills(orders: DataFrame, seed: int = 42) -> DataFrame:
    """Whether an order fills, drawn with the probability of its outcome from a hash of its id, and when: halfway to settlement."""
    u = F.pmod(F.xxhash64("order_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    p = F.when(F.col("result") == F.col("side"), F.col("p_won")).otherwise(F.col("p_lost"))
    return orders.withColumn("fills", u < p).withColumn("filled_us", F.floor((F.col("placed_us") + F.col("settled_us")) / 2))


def batches(rows: Iterator, size: int) -> Iterator[list]:
    """Q07: in runs of size."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
