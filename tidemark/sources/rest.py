"""List endpoints as a Spark data source.

Each window of time (or batch of keys) is a partition, so a failed one is read again alone. The fetch function is given the
request and returns a page of rows and the next cursor; retries and the rate limit are per task.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = (429, 500, 502, 503, 504)


class HttpError(Exception):
    def __init__(self, status: int):
        super().__init__(f"HTTP {status}")
        self.status = status


def with_retry(call: Callable[[], Any], tries: int = 5, base: float = 0.5, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Again after network errors, 429 and 5xx, with waits that double, up to a random part; other errors at once."""
    for i in range(tries):
        try:
            return call()
        except (HttpError, ConnectionError, TimeoutError) as e:
            if isinstance(e, HttpError) and e.status not in RETRIED or i == tries - 1:
                raise
            sleep(min(most, base * 2**i) * (0.5 + random.random() / 2))
    raise AssertionError


class Bucket:
    """So many calls a second: the share of this task of what the source allows."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.next, self.clock, self.sleep = 1 / per_second, 0.0, clock, sleep

    def take(self) -> None:
        now = self.clock()
        if self.next > now:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def pages(fetch: Callable[[dict], tuple[list, str | None]], request: dict, bucket: Bucket | None = None, tries: int = 5) -> Iterator[Any]:
    """All rows of a request, page by page until there is no cursor or it repeats."""
    seen: set[str] = set()
    cursor: str | None = None
    while True:
        if bucket:
            bucket.take()
        rows, cursor = with_retry(lambda c=cursor: fetch({**request, "cursor": c}), tries)
        yield from rows
        if not cursor or cursor in seen:
            return
        seen.add(cursor)


def offsets(fetch: Callable[[dict], list], request: dict, size: int = 500) -> Iterator[Any]:
    """Pages by offset until one is short."""
    at = 0
    while True:
        rows = with_retry(lambda a=at: fetch({**request, "offset": a, "limit": size}))
        yield from rows
        if len(rows) < size:
            return
        at += size


class Window(InputPartition):
    def __init__(self, request: dict):
        self.request = request


def list_source(name: str, schema: str, fetch: Callable[[dict], tuple[list, str | None]], requests: Sequence[dict], per_second: float | None = None) -> type[DataSource]:
    """A data source to register: spark.dataSource.register(...), spark.read.format(name)."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [Window(r) for r in requests]

        def read(self, partition):
            yield from pages(fetch, partition.request, Bucket(per_second) if per_second else None)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Source


def by_keys(keys: DataFrame, key: str, schema: str, fetch: Callable[[list], list[tuple]], batch: int = 50, tasks: int = 4) -> DataFrame:
    """Rows for batches of keys, in so many tasks at once."""
    import pandas as pd

    names = [f.strip().split()[0] for f in schema.split(",")]

    def work(frames):
        held: list = []
        for frame in frames:
            held += frame[key].tolist()
            while len(held) >= batch:
                yield pd.DataFrame(with_retry(lambda b=held[:batch]: fetch(b)), columns=names)
                held = held[batch:]
        if held:
            yield pd.DataFrame(with_retry(lambda: fetch(held)), columns=names)

    return keys.select(key).repartition(tasks).mapInPandas(work, schema)
