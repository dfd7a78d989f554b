"""Fitted tables by estimator and the time from which they may be used, as Parquet partitions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.framework.features import in_utc
from tidemark.operators.sinks import publish, published


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        at = jvm.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, estimator: str, available: datetime) -> str:
        return f"{self.root}/{estimator}/available={in_utc(available):%Y%m%dT%H%M%S%f}"

    def save(self, estimator: str, available: datetime, table: DataFrame) -> None:
        publish(table, self.path(estimator, available))

    def times(self, estimator: str) -> list[datetime]:
        """All times that there is a table of, in order."""
        fs, at = self._fs(f"{self.root}/{estimator}")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        stamps = [n.removeprefix("available=") for n in names if n.startswith("available=") and "." not in n]
        return sorted(in_utc(datetime.strptime(x, "%Y%m%dT%H%M%S%f")) for x in stamps)

    def load(self, estimator: str, as_of: datetime, max_age: timedelta | None = None) -> tuple[datetime, DataFrame] | None:
        """The newest table that was available at as_of, unless it is older than max_age."""
        as_of = in_utc(as_of)
        usable = [t for t in self.times(estimator) if t <= as_of]
        if not usable or max_age is not None and as_of - usable[-1] > max_age:
            return None
        return usable[-1], published(self.spark, self.path(estimator, usable[-1]))

    def metadata(self) -> DataFrame:
        """estimator and available of all tables."""
        fs, at = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        rows = [(n, t) for n in sorted(names) for t in self.times(n)]
        return self.spark.createDataFrame(rows, "estimator string, available timestamp").select("estimator", F.col("available"))
