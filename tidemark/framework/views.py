"""Estimators, and views of what was known at a boundary."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.framework.artifacts import Store
from tidemark.framework.features import Computed, Registry, in_order, in_utc
from tidemark.functions import exprs as X
from tidemark.operators import calibration as C
from tidemark.operators import joins as J


@dataclass(frozen=True)
class Estimator:
    """How a table is fitted to features (by name) and to other estimators' tables, and how it is looked up."""

    name: str
    calibrate: Callable[[dict[str, DataFrame], dict[str, DataFrame]], DataFrame]
    features: Sequence[str] = ()
    needs: Sequence[str] = ()
    lookup: Callable[..., DataFrame] | None = None


@dataclass(frozen=True)
class View:
    """What was known at as_of. Lookups join whole tables of questions."""

    as_of: datetime
    registry: Registry
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    lookups: Mapping[str, Callable[..., DataFrame]] = field(default_factory=dict)
    available: Mapping[str, datetime] = field(default_factory=dict)

    def __post_init__(self) -> None:
        late = {n: t for n, t in self.available.items() if t > self.as_of}
        if late:
            raise ValueError(f"tables of {sorted(late)} were not available at {self.as_of}")

    def feature(self, name: str, **params: Any) -> DataFrame:
        return self.registry.query(name, self.as_of, **params)

    def answer(self, estimator: str, questions: DataFrame, **params: Any) -> DataFrame:
        if estimator not in self.lookups:
            raise KeyError(f"the view has no lookup of {estimator!r}")
        return self.lookups[estimator](self.tables[estimator], questions, **params)

    def cost(self, cents: Column, quantity: Column) -> Column:
        return X.fee(cents, quantity)


class ViewFactory:
    """Builds views: each estimator, in order, from the store or else from what the boundary lets it see."""

    def __init__(self, registry: Registry, estimators: Sequence[Estimator], store: Store | None = None, max_age=None):
        self.registry, self.store, self.max_age = registry, store, max_age
        self.estimators = {e.name: e for e in estimators}
        if len(self.estimators) != len(estimators):
            raise ValueError("two estimators have one name")
        self.order = in_order({e.name: list(e.needs) for e in estimators})
        for e in estimators:
            for f in e.features:
                registry.get(f)

    def build(self, as_of: datetime, recalibrate: bool = False) -> View:
        as_of = in_utc(as_of)
        registry, tables, available = self.registry.clone(), {}, {}
        for name in self.order:
            e = self.estimators[name]
            held = None if self.store is None or recalibrate else self.store.load(name, as_of, self.max_age)
            if held is None:
                table = e.calibrate({f: registry.query(f, as_of) for f in e.features}, {n: tables[n] for n in e.needs})
                held = as_of, table
                if self.store is not None:
                    self.store.save(name, as_of, table)
                    held = self.store.load(name, as_of)
            available[name], tables[name] = held
        return View(as_of, registry, tables, {n: e.lookup for n, e in self.estimators.items() if e.lookup}, available)


def rate_of(rates: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions (gp, topic, hours, price in dollars) with the rate, its error and markets of their price bucket and time slice; null where none covers them."""
    asked = questions.withColumn("price_bucket", X.price_bucket(F.col("price")))
    return J.band(asked, rates, ["gp", "topic", "price_bucket"], "hours", "hours_from", "hours_to", "bucket_index", ["p_yes", "se", "n_markets"]).drop("price_bucket")


def observations_feature(name: str, rows: str, classes: str, inner: bool = True) -> Computed:
    """A feature of rows (series, ...) with gp and topic of their series, both at the same boundary. Rows of a series without a class go; with inner False they stay as unknown. A series that is classified twice counts once, with the least class."""

    def compute(f: dict[str, DataFrame]) -> DataFrame:
        known = f[classes].groupBy("series").agg(F.min(F.struct("gp", "topic")).alias("_class"))
        joined = f[rows].join(known, "series", "inner" if inner else "left")
        return joined.select(*f[rows].columns, *[F.coalesce(F.col(f"_class.{c}"), F.lit("unknown")).alias(c) for c in ("gp", "topic")])

    return Computed(name, compute, (rows, classes))


def event_rate_estimator(observations: str = "observations", price: str = "price", least: int = C.LEAST_MARKETS) -> Estimator:
    """V07."""
    return Estimator("event_rate", lambda f, _: C.event_rates(f[observations], price, least), (observations,), (), rate_of)


def classification_estimator(classes: str = "classes") -> Estimator:
    """The class of each series."""
    return Estimator("classification", lambda f, _: f[classes].dropDuplicates(["series"]), (classes,), (), lambda t, q: q.join(t, "series", "left"))


def temporal_validation(registry: Registry, estimator: Estimator, boundaries: Sequence[datetime], questions: Callable[[datetime, datetime], DataFrame], metric: Column) -> DataFrame:
    """Fit at each boundary, answer the questions between it and the next, and take the metric of the answers.

    Nothing that a fit sees is in the questions it answers. One row for each pair of boundaries.
    """
    out = None
    factory = ViewFactory(registry, [estimator])
    for start, end in zip(boundaries, boundaries[1:], strict=False):
        answers = factory.build(start).answer(estimator.name, questions(start, end))
        row = answers.agg(F.count("*").alias("n"), metric.alias("metric")).withColumn("boundary", F.lit(in_utc(start)))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("validation needs two boundaries")
    return out
