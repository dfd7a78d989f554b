"""More column rules: distribution functions, codes of enums, prices and names from raw fields."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape of the distribution of strikes.
PIT_ALPHA, PIT_BETA = 1.45, 1.42
#: Terms of the series, enough for a half at double precision.
TERMS = 60


def _series(x: Column, a: float, b: float) -> Column:
    """I_x(a, b) for x up to a half: x^a / B(a, b) times the sum of (1-b)_k x^k / (k! (a + k))."""
    coefficients, c = [], 1.0
    for k in range(TERMS):
        coefficients.append(c / (a + k))
        c *= (k + 1 - b) / (k + 1)
    beta = math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    total = F.aggregate(F.array(*[F.lit(c) for c in reversed(coefficients)]), F.lit(0.0), lambda s, c: s * x + c)
    return F.pow(x, F.lit(a)) / F.lit(beta) * total


def incomplete_beta(x: Column, a: float = PIT_ALPHA, b: float = PIT_BETA) -> Column:
    """The regularised incomplete beta function; 0 below 0 and 1 above 1."""
    inside = F.when(x <= 0.5, _series(x, a, b)).otherwise(1 - _series(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def pit_edge(yes_cents: Column, side: str) -> Column:
    """Cents that a YES (or NO) contract at a price is worth more than it costs, by the distribution of strikes."""
    no = incomplete_beta(1 - yes_cents / F.lit(100.0))
    return (1 - no) * 100 - yes_cents if side == "yes" else no * 100 - (100 - yes_cents)


def enum_code(value: Column, known: Sequence[str]) -> Column:
    """The place of a value among the known ones from 0; what isn't known comes after the last."""
    place = F.array_position(F.array(*[F.lit(k) for k in known]), value)
    return F.when(place > 0, place - 1).otherwise(len(known)).cast("int")


def rounded(value: Column, digits: int) -> Column:
    """Decimal rounding, half away from zero."""
    return F.round(value.cast("decimal(30,9)"), digits).cast("double")


def is_identifier(name: Column) -> Column:
    """lower-case names with dots, as they may stand in a statement."""
    return F.coalesce(name.rlike(r"^[a-z_][a-z0-9_.]*$"), F.lit(False))


def clean_resolution(p0: Column, p1: Column) -> Column:
    """0 or 1, the outcome whose price is over 0.9 while the other's is under 0.1; null otherwise."""
    return F.when((p0 > 0.9) & (p1 < 0.1), 0).when((p1 > 0.9) & (p0 < 0.1), 1)


def price_of_amounts(paid: Column, received: Column) -> Column:
    """Null unless both amounts are there."""
    return F.when((paid > 0) & (received > 0), paid / received)


def spread_bps(buy: Column, sell: Column) -> Column:
    """Of the mid; null without one."""
    return F.try_divide(buy - sell, (buy + sell) / F.lit(2.0)) * 10_000


def cents_or_null(bid: Column, ask: Column) -> Column:
    """Q36: whole-cent quotes of dollars, null unless both are above 0."""
    ok = (bid > 0) & (ask > 0)
    return F.when(ok, F.struct(F.bround(bid * 100).cast("int").alias("bid"), F.bround(ask * 100).cast("int").alias("ask")))


def ev_per_day(ev: Column, days: Column) -> Column:
    """Q37: without a floor; the value itself where no time is left."""
    return F.when(days > 0, ev / days).otherwise(ev)


def legacy_touch(side: Column, limit: Column, bid_high: Column, ask_low: Column) -> Column:
    """Q30: quotes alone reach a limit."""
    return F.when(side == "yes", F.coalesce(ask_low <= limit, F.lit(False))).otherwise(F.coalesce(100 - bid_high <= limit, F.lit(False)))


def estimate_by_order(*estimates: Column) -> Column:
    """Q32: the first estimator that knows, by its place."""
    return F.coalesce(*[F.when(e.isNotNull(), F.struct(F.lit(i).alias("source"), e.alias("value"))) for i, e in enumerate(estimates)])


def entry_price(filled: Column, resting: Column, exposure: Column, contracts: Column) -> Column:
    """Of the fill, else of the resting order, else from the exposure in dollars; 0 counts as missing."""
    guess = F.when(contracts > 0, F.floor(exposure * 100 / contracts).cast("int"))
    return F.coalesce(F.nullif(filled, F.lit(0)), F.nullif(resting, F.lit(0)), guess, F.lit(0))


def as_estimate(rate: Column) -> list[Column]:
    """Q48: a rate alone in the form of an estimate: no error, and support (a fixed value) that passes every threshold."""
    return [rate.alias("rate"), F.lit(0.0).alias("se"), F.lit(9999).alias("n")]
