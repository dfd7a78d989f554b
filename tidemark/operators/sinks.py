"""Write semantics over immutable files: what a table holds after an upsert, and how it is published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def splice(old: DataFrame, new: DataFrame, keys: Sequence[str], origin: str, *tie: Column) -> DataFrame:
    """One row a key. A historical row replaces a live one and stays, whatever comes later; a stored live row stays unless a historical one comes; within a batch the first by tie wins."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy((F.col(origin) == "historical").desc(), "_batch", *tie)
    return both.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "_batch")


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str], *tie: Column) -> DataFrame:
    """Rows of new whose key the table doesn't have, one a key."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    order = Window.partitionBy(*keys).orderBy(*(tie or [F.xxhash64(*new.columns)]))
    return fresh.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def overwrite_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """New rows replace old ones of their key but for the columns in keep."""
    right = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns], F.lit(True).alias("_new"))
    condition = [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys]
    joined = old.withColumn("_old", F.lit(True)).join(right, condition, "full")
    pick = lambda c: F.when(F.col("_new") & ~(F.coalesce("_old", F.lit(False)) & F.lit(c in keep)), F.col(f"_n_{c}")).otherwise(F.col(c))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def coalescing_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], text: Sequence[str] = (), most: Sequence[str] = (), positive: Sequence[str] = ()) -> DataFrame:
    """A new text if it isn't empty, the larger number, or a new number above 0; else the old value."""
    joined = old.alias("o").join(new.alias("n"), list(keys), "full")

    def pick(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in text:
            return F.coalesce(F.nullif(b, F.lit("")), a)
        if c in most:
            return F.greatest(a, b)
        return F.coalesce(F.when(b > 0, b), a) if c in positive else F.coalesce(b, a)

    return joined.select(*keys, *[pick(c).alias(c) for c in old.columns if c not in keys])


def supersede(live: DataFrame, current: DataFrame, keys: Sequence[str], column: str, now: Column) -> DataFrame:
    """Rows of the table that the last cycle didn't see get a time in column, unless they have one."""
    seen = current.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return live.join(seen, list(keys), "left").withColumn(column, F.when(F.col("_seen").isNull(), F.coalesce(F.col(column), now)).otherwise(F.col(column))).drop("_seen")


def order_status(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """Filled, partial or cancelled by the contracts filled."""
    done = fills.groupBy("order_id").agg(F.sum("count").alias("filled"))
    joined = orders.join(done, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    return joined.withColumn("status", F.when(F.col("filled") >= F.col("quantity"), "filled").when(F.col("filled") > 0, "partial").otherwise("cancelled"))


def without_old(df: DataFrame, time_us: str, as_of_us: int, days: int, drop: Column | None = None) -> DataFrame:
    """Rows of the last days before as_of, without those in drop."""
    kept = df.where(F.col(time_us) >= as_of_us - days * 86_400_000_000)
    return kept.where(~drop) if drop is not None else kept


def without_columns(df: DataFrame, time_us: str, as_of_us: int, days: int, columns: Sequence[str]) -> DataFrame:
    """Old rows stay, but lose heavy columns."""
    old = F.col(time_us) < as_of_us - days * 86_400_000_000
    return df.select(*[F.when(~old, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def _folders(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm, jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions of a table, the oldest first: a version counts from the moment its pointer is there."""
    jvm, fs = _folders(spark, path)
    if not fs.exists(jvm.Path(path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(jvm.Path(path))]
    return sorted(int(n.removeprefix("_current-")) for n in names if n.startswith("_current-"))


def publish(df: DataFrame, path: str, *partitions: str) -> None:
    """Write a new version beside the others, then one empty pointer file, whose creation is the swap: readers see all old or all new rows, and a failure before it leaves the table as it was. The version before stays for those who read it; older ones go."""
    spark = df.sparkSession
    jvm, fs = _folders(spark, path)
    before = _versions(spark, path)
    new = before[-1] + 1 if before else 1
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{path}/v={new}")
    fs.create(jvm.Path(f"{path}/_current-{new}"), False).close()
    for old in before[:-1]:
        fs.delete(jvm.Path(f"{path}/_current-{old}"), False)
        fs.delete(jvm.Path(f"{path}/v={old}"), True)


def published(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The last published version of a table; None if there is none."""
    versions = _versions(spark, path)
    if not versions:
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/v={versions[-1]}")


def overwrite_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
