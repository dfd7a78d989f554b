"""Features are functions of a time boundary that return DataFrames; a registry orders them by their dependencies."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = ("hourly", "daily", "weekly")


def in_utc(t: datetime) -> datetime:
    """A naive time is UTC."""
    return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)


def boundary(t: datetime, schedule: str) -> datetime:
    """The start of the hour, day or week (Monday) of a time."""
    t = in_utc(t)
    hour = t.replace(minute=0, second=0, microsecond=0)
    if schedule == "hourly":
        return hour
    day = hour.replace(hour=0)
    if schedule == "daily":
        return day
    if schedule == "weekly":
        return day - timedelta(days=day.weekday())
    raise ValueError(f"schedule {schedule!r} is none of {BUCKETS}")


class Feature(Protocol):
    name: str
    needs: Sequence[str]

    def query(self, as_of: datetime, **params: Any) -> DataFrame: ...


@dataclass
class Stored:
    """Rows of a table that became available before as_of. A literal bound, so files are pruned by it."""

    name: str
    table: Callable[[], DataFrame]
    available: str
    needs: Sequence[str] = ()

    def query(self, as_of: datetime, **params: Any) -> DataFrame:
        return self.table().where(F.col(self.available) < F.lit(in_utc(as_of)))


@dataclass
class Preloaded:
    """A DataFrame at hand, cut by a predicate that is given the boundary."""

    name: str
    data: DataFrame
    visible: Callable[[datetime], Any]
    needs: Sequence[str] = ()

    def query(self, as_of: datetime, **params: Any) -> DataFrame:
        return self.data.where(self.visible(in_utc(as_of)))


@dataclass
class Computed:
    """A function of the features it needs, all at the same boundary."""

    name: str
    compute: Callable[..., DataFrame]
    needs: Sequence[str] = ()
    registry: Registry | None = field(default=None, repr=False)

    def _inputs(self, as_of: datetime) -> dict[str, DataFrame]:
        if self.needs and self.registry is None:
            raise ValueError(f"{self.name} belongs to no registry")
        return {n: self.registry.query(n, as_of) for n in self.needs}

    def query(self, as_of: datetime, **params: Any) -> DataFrame:
        return self.compute(self._inputs(as_of), **params)


@dataclass
class Cached(Computed):
    """As computed at the start of the bucket of as_of, once for each bucket: rows of the current bucket are not seen."""

    bucket: str = "daily"
    held: dict[datetime, DataFrame] = field(default_factory=dict, repr=False)

    def query(self, as_of: datetime, **params: Any) -> DataFrame:
        at = boundary(as_of, self.bucket)
        if at not in self.held:
            self.held[at] = self.compute(self._inputs(at)).persist()
        return self.held[at]

    def release(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()


class Registry:
    """V02."""

    def __init__(self) -> None:
        self._features: dict[str, Any] = {}

    def register(self, feature: Any) -> None:
        if feature.name in self._features:
            raise ValueError(f"feature {feature.name!r} is registered already")
        if isinstance(feature, Computed):
            feature.registry = self
        self._features[feature.name] = feature

    def __contains__(self, name: str) -> bool:
        return name in self._features

    def get(self, name: str) -> Any:
        if name not in self._features:
            raise KeyError(f"no feature {name!r}")
        return self._features[name]

    def query(self, name: str, as_of: datetime, **params: Any) -> DataFrame:
        return self.get(name).query(as_of, **params)

    def order(self) -> list[str]:
        """Names, each after what it needs; of several that could come next the first by name."""
        return in_order({n: list(f.needs) for n, f in self._features.items()})

    def validate(self) -> None:
        self.order()

    def clone(self) -> Registry:
        """The same features, computed ones bound to the copy; caches start empty."""
        import copy

        out = Registry()
        for f in self._features.values():
            twin = copy.copy(f)
            if isinstance(twin, Cached):
                twin.held = {}
            out.register(twin)
        return out


def in_order(needs: Mapping[str, Sequence[str]]) -> list[str]:
    for name, wanted in needs.items():
        for w in wanted:
            if w not in needs:
                raise ValueError(f"{name!r} needs {w!r}, which isn't there")
    out: list[str] = []
    left = {n: set(w) for n, w in needs.items()}
    while left:
        ready = sorted(n for n, w in left.items() if not w)
        if not ready:
            raise ValueError(f"{sorted(left)} need each other")
        out.append(ready[0])
        del left[ready[0]]
        for w in left.values():
            w.discard(ready[0])
    return out
