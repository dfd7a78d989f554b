"""Structured Streaming forms of the batch operators. Sources are file streams with a schema; times are timestamps."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import shared_folder


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once_by_key(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """ST04: each key once, as long as repeats come within the delay."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def ohlc(stream: DataFrame, time: str, key: str, price: str, count: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """ST07: open, high, low, close and volume of tumbling windows. Equal times go by price."""
    order = F.struct(time, price)
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return w.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(count).alias("volume")).select(key, F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def sliding_volume(stream: DataFrame, time: str, key: str, count: str, width: str = "24 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """ST08."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width, step).alias("w"), key)
    return w.agg(F.sum(count).alias("volume")).select(key, F.col("w.start").alias("start"), "volume")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """ST09."""
    s = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return s.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def with_static(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """ST12."""
    return stream.join(static, key, "left")


def drawdowns(stream: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """ST10, ST11: running pnl, peak and drawdown of each key, kept between batches.

    Keys are dealt out to buckets by a hash, and a bucket is one state, so that a micro-batch costs Python a call for each bucket, not
    for each key. A call holds a bucket's rows of one micro-batch and folds them in the order of id, in whichever order the shuffle brings them;
    a file stream of one file a trigger keeps the order of files. Rows without a key are a bucket of their own; a pnl that is null adds nothing.
    """
    kind = dict(stream.dtypes)[key]

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values("id")
        keyless = k[0] < 0
        by = pd.Series(0, index=rows.index) if keyless else rows[key]
        pnl = rows["pnl"].fillna(0).astype("int64")
        groups = pd.DataFrame({"pnl": pnl, "running": pnl.groupby(by).cumsum()}).groupby(by, sort=False)
        new = groups.agg(cum=("pnl", "sum"), peak=("running", "max"), n=("pnl", "size"))
        if state.exists:
            keys, *values = state.get
            old = pd.DataFrame(dict(zip(("cum", "peak", "n"), values, strict=True)), index=[0] if keyless else keys)
            known = old.reindex(new.index, fill_value=0)
            rest = old.drop(new.index, errors="ignore")
        else:
            known, rest = new * 0, new[:0]
        now = pd.DataFrame({"cum": known["cum"] + new["cum"], "peak": known["peak"].clip(lower=known["cum"] + new["peak"]), "n": known["n"] + new["n"]})
        kept = pd.concat([rest, now])
        state.update(([None] if keyless else kept.index.tolist(), *(kept[c].tolist() for c in ("cum", "peak", "n"))))
        names = pd.Series([None], dtype=object) if keyless else now.index
        yield pd.DataFrame({"key": names, "n": now["n"].array, "cum": now["cum"].array, "peak": now["peak"].array, "drawdown": (now["peak"] - now["cum"]).array})

    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    return stream.select(F.col(key), "id", "pnl", bucket.alias("_bucket")).groupBy("_bucket").applyInPandasWithState(update, f"key {kind}, n long, cum long, peak long, drawdown long", f"keys array<{kind}>, cum array<long>, peak array<long>, n array<long>", "update", GroupStateTimeout.NoTimeout)


def spliced(stream: DataFrame, table: str, keys: list[str], checkpoint: str):
    """ST05: late and corrected rows: each batch is spliced into the published table at a path, historical over live. A batch that is repeated after a failure changes nothing more."""
    from tidemark.operators.sinks import publish, published, splice

    def merge(batch: DataFrame, _: int) -> None:
        old = published(batch.sparkSession, table, batch.schema)
        publish(splice(batch.limit(0) if old is None else old, batch, keys, "origin", F.xxhash64(*batch.columns)), table)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def polled(stream: DataFrame, path: str, checkpoint: str, every: str = "5 minutes"):
    """ST01, ST02, ST06: micro-batches at an interval, into Parquet. Offsets are in the checkpoint, from which a restart goes on."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def progress(query: StreamingQuery) -> list[dict]:
    """ST13: batch, rows and rows a second of the recent micro-batches."""
    return [{"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond} for p in query.recentProgress]


def stopped(query: StreamingQuery, seconds: int = 60) -> bool:
    """ST14: take up what is there, then stop; whether the query ended in time."""
    query.processAllAvailable()
    query.stop()
    return bool(query.awaitTermination(seconds))


class TopRows(StatefulProcessor):
    """The most rows of a key by volume, of equal ones the least id. A group of keys has one value state of at most that many for each, which a time to live in milliseconds may end."""

    def __init__(self, most: int, ttl_ms: int | None, kind: str) -> None:
        self.most, self.ttl_ms, self.kind = most, ttl_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", f"keys array<{self.kind}>, ids array<long>, volumes array<long>", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        keyless, old, best, fresh = key[0], self.top.get(), None, set()
        if old:
            best = pd.DataFrame({"key": 0 if keyless else old[0], "id": old[1], "volume": old[2]})
        for batch in rows:
            new = batch[["id", "volume"]].assign(key=0 if keyless else batch["key"])
            fresh.update(new["key"].unique())
            every = pd.concat([best, new], ignore_index=True).sort_values(["volume", "id"], ascending=[False, True])
            best = every.drop_duplicates(["key", "id"]).groupby("key", sort=False).head(self.most)
        self.top.update(([None] * len(best) if keyless else best["key"].tolist(), best["id"].tolist(), best["volume"].tolist()))
        out = best[best["key"].isin(fresh)]
        names = pd.Series([None] * len(out), dtype=object) if keyless else out["key"].array
        yield pd.DataFrame({"key": names, "rank": out.groupby("key").cumcount().array + 1, "id": out["id"].array, "volume": out["volume"].array})

    def close(self) -> None:
        pass


def top_rows(stream: DataFrame, most: int = 5, ttl_ms: int | None = None, buckets: int = 256) -> DataFrame:
    """O06, ST10: of (key, id, volume) the rows of largest volume of each key as of each micro-batch that has rows of it: key, rank, id, volume. An id that comes again counts with its largest volume. Needs the RocksDB state store (`rocksdb_state`).

    Keys share a state by a hash, so that a micro-batch costs Python a call and a look into the store for each bucket, not for each key. With a time to live each key has a state of its own, as each ends by itself. Rows without a key are a group of their own.
    """
    mode, kind = "ProcessingTime" if ttl_ms else "None", dict(stream.dtypes)["key"]
    # a null would turn the whole numbers of its data frame into floats
    filled = F.coalesce("key", F.lit(0).cast(kind)) if kind in ("tinyint", "smallint", "int", "bigint") else F.col("key")
    group = filled if ttl_ms else F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    rows = stream.select(filled.alias("key"), "id", "volume", F.col("key").isNull().alias("_keyless"), group.alias("_group"))
    return rows.groupBy("_keyless", "_group").transformWithStateInPandas(TopRows(most, ttl_ms, kind), f"key {kind}, rank long, id long, volume long", "update", mode)


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def run_once(stream: DataFrame, name: str, mode: str = "append", key: str | None = None) -> DataFrame:
    """ST03: all that is there, once, as a table in Parquet under the shared folder; no row passes through the driver. In complete mode the last batch is the table; in append mode all batches are; in update mode all are as well, but with a key only the rows of each key's last batch."""
    spark = stream.sparkSession
    path, schema, done = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", stream.schema, []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch_number={n}")
        done.append(n)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{path}/batches/batch_number={max(done)}")
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch_number long").parquet(f"{path}/batches")
    if key:
        newest = rows.groupBy(F.col(key).alias("_key")).agg(F.max("batch_number").alias("_newest"))
        rows = rows.join(newest, F.col(key).eqNullSafe(F.col("_key")) & (F.col("batch_number") == F.col("_newest")), "left_semi")
    return rows.drop("batch_number")
