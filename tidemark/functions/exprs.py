"""Scalar column expressions: keys, buckets, prices, fees, expected values.

Prices are integer cents (`*_cents`) or double dollars; a function says which it takes. Bounds are literal, because
floor(price / width) is wrong where the division isn't exact (0.3 / 0.05 is less than 6).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket bounds, labels, price limits and fee rates.
REPORT_HOURS = [(0, 1, "0-1h"), (1, 3, "1-3h"), (3, 6, "3-6h"), (6, 12, "6-12h"), (12, 24, "12-24h"), (24, None, "24h+")]
FLOW_HOURS = [(1, "<1h"), (3, "1-3h"), (6, "3-6h"), (12, "6-12h"), (24, "12-24h"), (72, "1-3d"), (None, "3-7d")]
FILL_HOURS = [(1, "<1h"), (3, "<3h"), (6, "<6h"), (12, "<12h"), (24, "<24h"), (72, "<72h"), (168, "<168h"), (None, ">168h")]
COARSE_TIME = {"<1h": "short", "1-3h": "short", "3-6h": "short", "6-12h": "medium", "12-24h": "medium", "1-3d": "long", "3-7d": "long"}
VOLUME_BOUNDS = [(0, 0, "dead"), (1, 100, "low"), (101, 1000, "moderate"), (1001, 10000, "active")]
TAIL_LOW, TAIL_HIGH = 85, 97
MAKER_RATE, TAKER_RATE = 0.0175, 0.07
MIN_DAYS = 1 / 48
# Patterns of strikes in tickers, after -T, after the last dash, and of a ticker that ends in one.
STRIKE_MARKED, STRIKE_LAST, STRIKE_SUFFIX = r"-T(-?[\d.]+)$", r"-(-?[\d.]+)$", r"-[A-Z]{0,4}[\d]+\.?[\d]*$"


def series(ticker: Column) -> Column:
    """What stands before the first dash."""
    return F.split_part(ticker, F.lit("-"), F.lit(1))


def event_of(ticker: Column) -> Column:
    """All but the last part."""
    return F.regexp_replace(ticker, "-[^-]*$", "")


def hours_between(start: Column, end: Column) -> Column:
    """Fractional hours from start to end."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def price_bucket(price: Column) -> Column:
    """X11: index 0-19 of the half-open 5-cent bin of a price in dollars; null outside [0, 1). The quotient is only a guess that the bin's own bounds correct."""
    guess = F.floor(price * 20)
    bound = lambda i: i * 5 / F.lit(100.0)
    index = F.when(price < bound(guess), guess - 1).when(price >= bound(guess + 1), guess + 1).otherwise(guess)
    return F.when((price >= 0) & (price < 1), index.cast("int"))


def report_time_bucket(hours: Column) -> Column:
    """Six bins; null for negative hours."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(REPORT_HOURS):
        out = F.when((hours >= low) & (F.lit(True) if high is None else hours < high), label).otherwise(out)
    return out


def _first_below(value: Column, bounds: Sequence[tuple]) -> Column:
    out = F.lit(bounds[-1][1])
    for high, label in reversed(bounds[:-1]):
        out = F.when(value < high, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def flow_time_bucket(hours: Column) -> Column:
    """Seven bins; negative hours are <1h, and all from three days on 3-7d."""
    return _first_below(hours, FLOW_HOURS)


def coarse_time_bucket(bucket: Column) -> Column:
    """The coarse bin of a flow bin."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in COARSE_TIME.items() for x in pair]), bucket)


def fill_time_bucket(hours: Column) -> Column:
    """Eight bins; negative hours are <1h."""
    return _first_below(hours, FILL_HOURS)


def volume_bucket(volume: Column) -> Column:
    """Closed integer ranges; what lies in none is high."""
    out = F.lit("high")
    for low, high, label in reversed(VOLUME_BOUNDS):
        out = F.when(volume.between(low, high), label).otherwise(out)
    return out


def snap_tail(cents: Column) -> Column:
    """Into the tail's range."""
    return F.greatest(F.lit(TAIL_LOW), F.least(F.lit(TAIL_HIGH), cents))


def relative_price(limit: Column, bid: Column, ask: Column, side: Column, clamp: bool = True) -> Column:
    """Where a limit lies between bid and ask, the book turned over for `no`. Clamped: within 0-1, 0.5 for a degenerate book; else null for one."""
    low = F.when(side == "no", 100 - ask).otherwise(bid)
    high = F.when(side == "no", 100 - bid).otherwise(ask)
    ratio = F.when(high > low, (limit - low) / (high - low))
    return F.when(ratio.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))) if clamp else ratio


def limit_at(bid: Column, ask: Column, relative: Column) -> Column:
    """The limit at a relative step, rounded half to even, from 1 to 99."""
    return F.greatest(F.lit(1), F.least(F.lit(99), bid + F.bround(relative * (ask - bid)).cast("int")))


def fee(cents: Column, quantity: Column, rate: float = MAKER_RATE) -> Column:
    """Whole cents, rounded up; none at 0 and 100."""
    p = cents / F.lit(100.0)
    return F.when((cents <= 0) | (cents >= 100), 0).otherwise(F.ceil(F.round(F.lit(rate) * quantity * p * (1 - p) * 100, 9))).cast("int")


def best_fee_quantity(cents: Column, most: int) -> Column:
    """Of 1 to most, the first quantity of the least fee for each contract."""
    options = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda q: F.struct((fee(cents, q) / q).alias("each"), q.alias("quantity")))
    return F.array_min(options)["quantity"]


def edge_per_day(edge: Column, days: Column) -> Column:
    """With half an hour as the least time."""
    return edge / F.greatest(days, F.lit(MIN_DAYS))


def trade_ev(p_event: Column, fill_won: Column, fill_lost: Column, limit: Column, side: Column, fee_cents: Column) -> Column:
    """Expected cents of a contract that fills with one probability if it will win and another if it will lose."""
    p = F.when(side == "no", 1 - p_event).otherwise(p_event)
    return p * fill_won * (100 - limit - fee_cents) - (1 - p) * fill_lost * (limit + fee_cents)


def pnl(entry: Column, exit_price: Column, contracts: Column, fees: Column) -> Column:
    """Cents."""
    return (exit_price - entry) * contracts - fees


def capital_days(entry: Column, contracts: Column, days: Column) -> Column:
    """With one day as the least time."""
    return entry * contracts * F.greatest(days, F.lit(1.0))


def opposing_flow(side: Column, limit: Column, yes_cents: Column, taker: Column, count: Column) -> Column:
    """Contracts of a print that would have reached a resting order: takers of the other side at its price or better."""
    yes = (side == "yes") & (taker == "no") & (yes_cents <= limit)
    no = (side == "no") & (taker == "yes") & (yes_cents >= 100 - limit)
    return F.when(yes | no, count).otherwise(0)


def calibration_edge(side: Column, p_event: Column, price: Column) -> Column:
    """X27."""
    return F.when(side == "yes", p_event - price).otherwise(price - p_event)


def log_linear(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Straight in the logarithm of x."""
    return y0 + (y1 - y0) * (F.ln(x) - F.ln(x0)) / (F.ln(x1) - F.ln(x0))


def cdf_lookup(thresholds: Column, exceed: Column, quantity: Column, n: Column, enough: int = 200) -> Column:
    """The chance that a flow reaches quantity.

    1 at 0 or less, 0 for an empty table; up to the least threshold what that gives, between thresholds straight in the
    logarithm; past the last what that gives, or with enough observations on along the last two, and 0 from over twice the last.
    """
    many = F.size(thresholds)
    below = F.size(F.filter(thresholds, lambda t: t <= quantity))
    at = lambda a, i: F.try_element_at(a, i.cast("int"))
    inside = log_linear(quantity, at(thresholds, below), at(exceed, below), at(thresholds, below + 1), at(exceed, below + 1))
    last, before = F.lit(-1), F.lit(-2)
    on = log_linear(quantity, at(thresholds, before), at(exceed, before), at(thresholds, last), at(exceed, last))
    on = F.when((at(exceed, before) > 0) & (at(exceed, last) > 0), F.greatest(F.lit(0.0), on)).otherwise(F.lit(0.0))
    past = F.when(quantity > 2 * at(thresholds, last), F.lit(0.0)).when((n >= enough) & (many > 1), on).otherwise(at(exceed, last))
    return F.when(quantity <= 0, F.lit(1.0)).when(many == 0, F.lit(0.0)).when(quantity <= at(thresholds, F.lit(1)), at(exceed, F.lit(1))).when(quantity > at(thresholds, last), past).when(below == many, at(exceed, last)).otherwise(inside)


def strike_of(ticker: Column) -> Column:
    """The number after -T, or else after the last dash; null if there is none."""
    marked = F.regexp_extract(ticker, STRIKE_MARKED, 1)
    plain = F.regexp_extract(ticker, STRIKE_LAST, 1)
    return F.coalesce(F.nullif(marked, F.lit("")), F.nullif(plain, F.lit(""))).try_cast("double")


def binomial_se(p: Column, n: Column) -> Column:
    """A06."""
    return F.sqrt(p * (1 - p) / n)


def favorite_price(price: Column) -> Column:
    """the favourite's price in dollars if it is 0.85 to 0.97, else null."""
    return F.when(price.between(0.85, 0.97), price).when(price.between(0.03, 0.15), F.round(1 - price, 10))


def favorite_won(price: Column, yes: Column) -> Column:
    """whether the favourite won."""
    return F.when(price.between(0.85, 0.97), yes).when(price.between(0.03, 0.15), ~yes)


def tails(bid: Column, ask: Column, widest: int = 10) -> Column:
    """an array of the sides whose whole-cent mid is 85 to 97: struct(side, mid, spread). Empty for a crossed, missing or wide book."""
    spread = ask - bid
    fine = (bid > 0) & (ask > 0) & (spread >= 0) & (spread <= widest)
    yes_mid, no_mid = F.floor((bid + ask) / 2).cast("int"), F.floor((200 - ask - bid) / 2).cast("int")
    item = lambda side, mid: F.when(fine & mid.between(TAIL_LOW, TAIL_HIGH), F.struct(F.lit(side).alias("side"), mid.alias("mid"), spread.cast("int").alias("spread")))
    return F.array_compact(F.array(item("yes", yes_mid), item("no", no_mid)))


def touched(side: Column, limit: Column, bid_high: Column, ask_low: Column, price_high: Column, price_low: Column) -> Column:
    """Whether a candle reaches a resting limit; a price of 0 or null is unavailable."""
    yes = F.coalesce(ask_low <= limit, F.lit(False)) | F.coalesce((price_low > 0) & (price_low <= limit), F.lit(False))
    no = F.coalesce(100 - bid_high <= limit, F.lit(False)) | F.coalesce((price_high > 0) & (100 - price_high <= limit), F.lit(False))
    return F.when(side == "yes", yes).when(side == "no", no).otherwise(F.raise_error(F.concat(F.lit("no such side: "), side)))


def fillable(volume: Column, remaining: Column, rate: float, least: int, needs_volume: bool = True) -> Column:
    """M02."""
    some = F.least(F.greatest(F.floor(volume * rate).cast("int"), F.lit(least)), remaining)
    return F.when(F.lit(needs_volume) & ~F.coalesce(volume > 0, F.lit(False)), 0).otherwise(some)
