"""Written tables in the shared folder, streaming over sorted groups, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: it cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of save() that nothing reads any more."""
    if path := getattr(df, "_scratch", None):
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def uniform(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) from the MD5 of the key and a seed: the same in every run and on every engine."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Cut a stream sorted by keys into pieces of one key each: (key, rows, is it the first piece of that key)."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        here = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(here) + 1):
            if i == len(here) or here[i] != here[start]:
                yield here[start], batch.slice(start, i - start), here[start] != last
                last, start = here[start], i


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of one key at a time. Only for keys that a block number bounds."""
    held: list[pa.RecordBatch] = []
    key: tuple = ()
    for k, piece, first in runs(batches, keys):
        if first and held:
            yield key, pa.Table.from_batches(held)
            held = []
        key = k
        held.append(piece)
    if held:
        yield key, pa.Table.from_batches(held)


def by_bytes(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of at most about limit bytes each, and of at least one row."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the least node of the component of each node that an edge (u, v) names.

    Alternating large-star and small-star steps, O(log n) rounds. The least neighbour is found by an aggregation,
    which combines before the shuffle, and written, so that the join back is one whose hot nodes Spark can split.
    """
    now = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), name)
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mid = save(large, name)
        least2 = save(mid.groupBy("u").agg(F.min("v").alias("m")), name)
        small = mid.join(least2, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = save(small, name)
        for old in (now, least, mid, least2):
            discard(old)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v"), F.col("v")).distinct())


def per_partition(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)
