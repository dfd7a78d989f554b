"""Streaming results are read from files, not held by the driver."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import streams


@pytest.mark.parametrize("mode", ["append", "update", "complete"])
def test_results_are_files(spark, tmp_path, mode):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = streams.files(spark, str(tmp_path), "id long", 1)
    if mode != "append":
        stream = stream.groupBy((F.col("id") % 2).alias("id")).count()
    out = streams.run_once(stream, f"result_{mode}", mode)
    want = {"append": 30, "update": 6, "complete": 2}
    assert out.count() == want[mode] and out.inputFiles()
    if mode == "complete":
        assert sorted(map(tuple, out.collect())) == [(0, 15), (1, 15)]


def test_splice_goes_on_from_its_checkpoint(spark, tmp_path):
    """Batches that come after a restart are spliced once each: historical over live, stored rows before new ones of their origin."""
    from tidemark.operators.sinks import published

    source, table, log = (str(tmp_path / n) for n in ("in", "table", "log"))
    schema = "k int, origin string, v int"
    for rows, want in (([(1, "live", 1), (2, "historical", 1)], {1: 1, 2: 1}), ([(1, "historical", 2), (2, "historical", 2), (3, "live", 1)], {1: 2, 2: 1, 3: 1}), ([(1, "live", 3), (3, "live", 2)], {1: 2, 2: 1, 3: 1})):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streams.spliced(streams.files(spark, source, schema, 1), table, ["k"], log).start().awaitTermination()
        assert {r.k: r.v for r in published(spark, table).collect()} == want


def test_state_survives_a_restart(spark, tmp_path):
    """ST10: running sums go on where the checkpoint left them."""
    source, log, got = str(tmp_path / "in"), str(tmp_path / "log"), {}

    def keep(batch, _):
        got.update({r.key: (r.n, r.cum, r.peak, r.drawdown) for r in batch.collect()})

    for ids, want in ((range(0, 4), (4, 6, 6, 0)), (range(4, 6), (6, 15, 15, 0))):
        spark.createDataFrame([(i, 7, i) for i in ids], "id long, user long, pnl long").coalesce(1).write.mode("append").parquet(source)
        stream = streams.drawdowns(streams.files(spark, source, "id long, user long, pnl long", 1), "user")
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        assert got[7] == want


def test_drawdown_order_and_calls(spark, tmp_path):
    """ST10, ST11: many keys share a call and a state; rows of one micro-batch are folded by id, in whatever order and pieces they come."""
    source, log, got, plain = str(tmp_path / "in"), str(tmp_path / "log"), {}, {}
    draw = random.Random(4)
    for f in range(2):
        rows = [(f * 600 + i, draw.choice([None, *range(2**60, 2**60 + 40), *[7] * 60]), draw.randrange(-9, 10)) for i in range(600)]
        for _, k, v in rows:
            n, cum, peak = plain.get(k, (0, 0, 0))
            plain[k] = (n + 1, cum + v, max(peak, cum + v))
        draw.shuffle(rows)
        spark.createDataFrame(rows, "id long, user long, pnl long").coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        stream = streams.drawdowns(streams.files(spark, source, "id long, user long, pnl long", 1), "user", 4)
        q = stream.writeStream.foreachBatch(lambda b, _: got.update({r.key: (r.n, r.cum, r.peak) for r in b.collect()})).outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 + 1


def test_top_rows_share_states(spark, tmp_path):
    """Keys share states, so a micro-batch looks into the store once a bucket; whole keys stay whole beside rows without one."""
    source, log, got, seen = str(tmp_path / "in"), str(tmp_path / "log"), {}, {}
    draw = random.Random(5)

    def keep(batch, _):
        fresh = {}
        for r in batch.collect():
            fresh.setdefault(r.key, {})[r.rank] = (r.id, r.volume)
        got.update(fresh)

    for _ in range(2):
        rows = [(draw.choice([None, *range(2**60, 2**60 + 40)]), draw.randrange(200), draw.randrange(90)) for _ in range(600)]
        for k, i, v in rows:
            seen.setdefault(k, {})[i] = max(v, seen.get(k, {}).get(i, v))
        spark.createDataFrame(rows, "key long, id long, volume long").coalesce(1).write.mode("append").parquet(source)
    stream = streams.top_rows(streams.files(spark, source, "key long, id long, volume long", 1), buckets=4)
    with streams.rocksdb_state(spark):
        q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == {k: dict(enumerate(sorted(x.items(), key=lambda r: (-r[1], r[0]))[:5], 1)) for k, x in seen.items()}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 + 4


def test_polling_stop_and_progress(spark, tmp_path):
    """ST01, ST02, ST06, ST13, ST14: a second query takes up only what the first hasn't seen."""
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for n in (3, 5):
        spark.range(n).coalesce(1).write.mode("append").parquet(source)
        q = streams.polled(streams.files(spark, source, "id long"), out, log, "1 second").start()
        assert streams.stopped(q) and sum(p["rows"] for p in streams.progress(q)) == n
    assert spark.read.parquet(out).count() == 8


def test_with_static(spark, tmp_path):
    spark.createDataFrame([(1, 10), (2, 20)], "k int, v int").coalesce(1).write.parquet(str(tmp_path / "in"))
    static = spark.createDataFrame([(1, "a")], "k int, name string")
    out = streams.run_once(streams.with_static(streams.files(spark, str(tmp_path / "in"), "k int, v int"), static, "k"), "static")
    assert sorted(map(tuple, out.collect())) == [(1, 10, "a"), (2, 20, None)]
