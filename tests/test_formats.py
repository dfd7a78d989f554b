"""Documents of several formats, inferred CSV, append sinks, counts from footers, and rates over all price methods."""

import glob
import os
import subprocess
import sys
import textwrap

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration as C
from tidemark.operators import health as H
from tidemark.operators import joins as J
from tidemark.operators import track as T
from tidemark.session import ROOT
from tidemark.sources import append as A
from tidemark.sources import delimited as D
from tidemark.sources import documents as N
from tidemark.sources import parsers as P

BOOKS = [
    ("new", '{"orderbook_fp":{"yes_dollars":[["0.85","100.00"],["0.295","7.9"]],"no_dollars":null}}', ("new", [(85, 100), (30, 7)], [])),
    ("old", '{"orderbook":{"yes":[[85,100]],"no":[[10,3],[12,4]]}}', ("old", [(85, 100)], [(10, 3), (12, 4)])),
    ("both", '{"orderbook_fp":{"yes_dollars":[["0.01","1"]]},"orderbook":{"yes":[[2,2]]}}', ("new", [(1, 1)], [])),
    ("empty new", '{"orderbook_fp":{},"orderbook":{"no":[[2,2]]}}', ("old", [], [(2, 2)])),
    ("null new", '{"orderbook_fp":null,"orderbook":null}', ("none", [], [])),
    ("neither", '{"x":1}', ("none", [], [])),
    ("no list", '{"orderbook":{"yes":"many","no":[]}}', ("old", [], [])),
    ("bad level", '{"orderbook_fp":{"yes_dollars":[["x","1"],["0.5"]]}}', ("new", [(None, 1), (50, None)], [])),
    ("cut", '{"orderbook":{"yes":[[85,', (None, None, None)),
    ("no object", "[1,2]", (None, None, None)),
    ("blank", "", (None, None, None)),
    ("null", None, (None, None, None)),
]


def test_books_of_both_formats(spark):
    df = spark.createDataFrame([(n, b) for n, b, _ in BOOKS], "name string, body string")
    pairs = lambda s: None if s is None else [(x.price, x.quantity) for x in s]
    got = {r.name: (r.format, pairs(r.yes), pairs(r.no)) for r in N.books(df, "body", "name").collect()}
    assert got == {n: w for n, _, w in BOOKS}
    assert N.books(df.limit(0), "body", "name").count() == 0


def test_contracts_without_ids_and_documents_that_are_cut(spark):
    body = """{"markets":[
      {"id":1,"shortName":"A","contracts":[{"id":"11","name":"x","bestBuyYesCost":0.6,"bestSellYesCost":0.5,"lastTradePrice":"0.55"},{"id":0},{"name":"y"},{"id":12,"bestBuyYesCost":0.6,"bestSellYesCost":null},{"id":13,"bestBuyYesCost":0,"bestSellYesCost":0.1}]},
      {"id":null,"contracts":[{"id":21}]},{"id":3},{"id":4,"contracts":[]},{"id":5,"contracts":{"id":51}},7]}"""
    df = spark.createDataFrame([(1, body, "a"), (2, body[:-1], "b"), (3, None, "c"), (4, '{"markets":null}', "d"), (5, "{}", "e")], "k int, body string, name string").withColumnRenamed("name", "position_")
    got = N.contracts(df, "body", "k", "position_").collect()
    assert [(r.k, r.market_id, r.market_name, r.position, r.contract_id, r.name, r.buy_yes, r.sell_yes, r.last_trade) for r in sorted(got, key=lambda r: r.contract_id)] == [
        (1, 1, "A", 0, 11, "x", 0.6, 0.5, 0.55), (1, 1, "A", 3, 12, None, 0.6, None, None), (1, 1, "A", 4, 13, None, 0.0, 0.1, None)]
    assert [r.spread_bps and round(r.spread_bps, 3) for r in sorted(got, key=lambda r: r.contract_id)] == [1818.182, None, None]


def test_csv_types_and_bad_lines_as_another_reader_has_them(spark, tmp_path):
    lines = ["n,x,day,at,flag,word,none"]
    lines += [f"{i},{i / 4},2024-01-{1 + i % 28:02d},2024-01-01 00:00:{i % 60:02d},{'true' if i % 2 else 'FALSE'},w{i}," for i in range(200)]
    lines += ["oops,1.5,2024-01-01,2024-01-01 00:00:00,true,w,", "7,1.5", "8,1.5,2024-01-01,2024-01-01 00:00:00,true,w,,more", '9,2.5,2024-01-01,2024-01-01 00:00:00,true,"a,b",']
    file = tmp_path / "f.csv"
    file.write_text("\n".join(lines) + "\n")
    got = D.read_csv(spark, str(file), tolerance=0.02)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "double", "date", "timestamp", "boolean", "string", "string", "string"]
    bad = got.where(F.col(D.CORRUPT).isNotNull())
    assert sorted(r[D.CORRUPT] for r in bad.select(D.CORRUPT).collect()) == sorted(lines[-4:-1])
    assert got.count() == 204
    assert bad.count() == bad.agg(F.count("*"), F.max("x")).first()[0] == 3  # whichever columns are read
    con = duckdb.connect()
    good = con.execute(f"SELECT count(*), sum(n), sum(x), min(day)::VARCHAR, max(word) FROM read_csv('{file}', ignore_errors = true, null_padding = false, columns = {{n: 'BIGINT', x: 'DOUBLE', day: 'DATE', \"at\": 'TIMESTAMP', flag: 'BOOLEAN', word: 'VARCHAR', none: 'VARCHAR'}}, header = true, auto_detect = false, delim = ',', quote = '\"')").fetchone()
    ok = got.where(F.col(D.CORRUPT).isNull())
    assert tuple(ok.agg(F.count("*"), F.sum("n"), F.sum("x"), F.min("day").cast("string"), F.max("word")).first()) == good
    assert D.inferred(spark, str(file))["n"].dataType.simpleString() == "string"  # nothing is tolerated


def test_csv_without_rows_and_from_a_sample(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    assert D.read_csv(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "s.csv").write_text("a\n" + "".join(f"{i}\n" for i in range(5000)) + "word\n")
    got = D.read_csv(spark, str(tmp_path / "s.csv"), share=0.1, tolerance=0.01)
    assert got.schema["a"].dataType.simpleString() == "bigint"
    assert got.where(F.col(D.CORRUPT).isNotNull()).select(D.CORRUPT, "a").collect()[0][0] == "word"


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_a_transaction_adds_its_rows_once(spark, tmp_path, kind):
    A.register(spark)
    path, form = f"{tmp_path}/out", {"csv": "append_csv", "json": "append_lines"}[kind]
    df = spark.range(0, 50, 1, 3).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('a,"\n'), "id")).alias("text"), (F.col("id") / 8).alias("x"))
    back = lambda: sorted(tuple(r) for r in spark.read.schema(df.schema).options(header=True, multiLine=kind == "csv", escape='"').format(kind).load(path).collect())
    want = sorted(tuple(r) for r in df.collect())
    write = lambda d, name: d.write.format(form).mode("append").option("transaction", name).save(path)
    write(df, "one")
    assert back() == want
    write(df, "one")
    assert back() == want
    write(df.repartition(5), "two")
    assert back() == sorted(want * 2)
    # a commit that was cut off: its files are there, its marker isn't, and it had other partitions
    os.remove(f"{path}/_committed-two")
    write(df, "two")
    assert back() == sorted(want * 2)
    assert not glob.glob(f"{path}/.staged-*")
    write(df.limit(0), "none")
    assert back() == sorted(want * 2)
    with pytest.raises(Exception, match="letters, digits"):
        write(df, "a-b")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = A.Folder(f"{tmp_path}/f", "json")

    def batches():
        yield pa.RecordBatch.from_pydict({"a": [1, 2]})
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        folder.stage(batches())
    assert os.listdir(tmp_path / "f") == []
    done = folder.stage(iter([pa.RecordBatch.from_pydict({"a": [1, 2]})]))
    assert done.rows == 2
    folder.abort([done, None])
    assert os.listdir(tmp_path / "f") == []


def test_tasks_that_fail_midway_are_run_again_and_add_each_row_once(tmp_path):
    """In a session of its own, whose tasks may fail three times: each first attempt stops after it has staged rows."""
    script = f"""
    import os, sys
    sys.path.insert(0, {ROOT!r})
    from pyspark.sql import SparkSession
    from tidemark.session import workers_see_package
    workers_see_package()
    spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "100").getOrCreate()
    from tidemark.sources import append as A
    A.register(spark)

    def failing(frames):
        from pyspark import TaskContext
        for i, f in enumerate(frames):
            if i == 2 and TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("lost on purpose")
            yield f

    spark.range(0, 1000, 1, 2).mapInPandas(failing, "id long").write.format("append_csv").mode("append").option("transaction", "t").save({str(tmp_path / "out")!r})
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "lost on purpose" in done.stderr
    rows = [int(x) for f in glob.glob(f"{tmp_path}/out/part-t-*.csv") for x in open(f).read().replace('"', "").split()[1:]]
    assert sorted(rows) == list(range(1000))


def test_a_stream_that_is_started_again_adds_each_batch_once(spark, tmp_path):
    A.register(spark)
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(state):
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        q = rows.writeStream.format("append_lines").option("path", path).option("transaction", "s").option("checkpointLocation", f"{tmp_path}/{state}").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.id for r in spark.read.schema("id long").json(path).collect())

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    assert run("a") == list(range(30))
    spark.range(30, 40).coalesce(1).write.mode("append").parquet(source)
    assert run("a") == list(range(40))
    assert run("lost") == list(range(40))  # the same batches, by a stream that has forgotten what it did


def test_footer_counts_read_no_data(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).select("id", (F.col("id") / 4).alias("x"), F.when(F.col("id") < 0, 1).alias("none"))
    df.write.parquet(f"{tmp_path}/t")
    assert H.footer_counts(spark, f"{tmp_path}/t", "id", "x", "none").first().asDict() == {"n": 1000, "first_id": 0, "last_id": 999, "first_x": 0.0, "last_x": 249.75, "first_none": None, "last_none": None}
    with H._footers(spark):
        plan = spark.read.parquet(f"{tmp_path}/t").agg(F.count("*"), F.max("id"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedAggregation: [COUNT(*), MAX(id)]" in plan
    df.limit(0).write.parquet(f"{tmp_path}/e")
    assert tuple(H.footer_counts(spark, f"{tmp_path}/e", "id").first()) == (0, None, None)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_series_pages_without_missing_values(spark):
    pages = [(1, '{"count":4,"observations":[{"date":"2024-01-01","value":"."},{"date":"2024-01-02","value":"1.5"},{"date":"2024-01-03","value":""},{"date":"2024-01-04","value":null}]}'), (2, '{"observations":[{"date":"x","value":2},{"date":"2024-02-01","value":"-3e2"},{"value":"many"}]}'), (3, "{"), (4, None), (5, '{"observations":[]}')]
    got = P.series_observations(spark.createDataFrame(pages, "k int, body string"), "body", "k").collect()
    assert sorted((r.k, str(r.date), r.value) for r in got) == [(1, "2024-01-02", 1.5), (2, "2024-02-01", -300.0), (2, "None", 2.0)]


def test_event_columns_double_no_market(spark):
    markets = spark.createDataFrame([("m1", "e1"), ("m2", "e1"), ("m3", "e2"), ("m4", "e3"), ("m5", None)], "ticker string, event_ticker string")
    events = spark.createDataFrame([("e1", "c", "t"), ("e1", "b", "u"), ("e2", None, "x"), (None, "n", "n")], "event_ticker string, category string, title string")
    got = sorted(tuple(r) for r in J.with_event(markets, events, event_category="category", event_title="title").collect())
    assert got == [("m1", "e1", "b", "u"), ("m2", "e1", "b", "u"), ("m3", "e2", None, "x"), ("m4", "e3", None, None), ("m5", None, None, None)]


def test_running_totals_over_blocks_of_blocks(spark):
    rows = [(i * 7 % 401 - 50, i) for i in range(401)]
    want = {k: sum(v for j, v in rows if j <= k) for k, _ in rows}
    got = {r.k: r.run for r in T.running_total(spark.createDataFrame(rows, "k long, v long").repartition(4), "k", "v", "run", 5).collect()}
    assert got == want
    assert T.running_total(spark.createDataFrame([], "k long, v long"), "k", "v", "run").count() == 0


def test_averaged_rates(spark):
    cell = lambda m, b, i, low, high, p, se, n: ("g", "t", m, b, i, low, high, p, se, n)
    rates = spark.createDataFrame(
        [cell("bid", 10, 0, 0.0, 5.0, 0.4, 0.1, 70), cell("bid", 10, 1, 5.0, 9.0, 0.6, 0.3, 60), cell("mid", 10, 0, 0.0, 9.0, 0.5, 0.2, 90), cell("ask", 11, 0, 2.0, 9.0, 0.9, 0.0, 50), cell("trade", 19, 0, 0.0, 9.0, 1.0, 0.4, 55)],
        "gp string, topic string, method string, price_bucket int, bucket_index int, hours_from double, hours_to double, p_yes double, se double, n_markets long",
    )
    asked = [
        ("all but trade", "g", "t", 5.0, 50, 58, 0), ("ask in a gap", "g", "t", 1.0, 50, 58, None), ("trade too", "g", "t", 9.0, 50, 58, 99), ("too late", "g", "t", 9.5, 50, 58, 99),
        ("other class", "g", "u", 5.0, 50, 58, 99), ("no class", None, "t", 5.0, 50, 58, 99), ("no bid", "g", "t", 5.0, None, 58, None), ("over a dollar", "g", "t", 5.0, 100, 100, 100), ("no hours", "g", "t", None, 50, 58, 99),
    ]
    questions = spark.createDataFrame(asked, "k string, gp string, topic string, hours double, bid int, ask int, trade int")
    r = lambda x: None if x is None else round(x, 9)
    got = {x.k: (r(x.rate), r(x.se), x.n_markets, x.n_methods) for x in C.averaged_rates(questions, rates).collect()}
    none = (None, None, None, 0)
    assert got == {
        "all but trade": (0.6, 0.1, 50, 3), "ask in a gap": (0.45, 0.15, 70, 2), "trade too": (0.75, 0.225, 50, 4), "too late": none, "other class": none, "no class": none,
        "no bid": (0.9, 0.0, 50, 1), "over a dollar": none, "no hours": none,
    }
    assert {x.n_methods for x in C.averaged_rates(questions, rates.limit(0)).collect()} == {0}


def test_rates_by_method_are_those_of_each_method_alone(spark):
    rows = [("g" if i % 3 else None, "t", f"m{i % 120}", float(i % 50), i % 7 > 2, i, i, 40 + i % 20, 45 + i % 20, i % 4 * 20, "a") for i in range(1500)]
    obs = spark.createDataFrame(rows, "gp string, topic string, ticker string, hours double, yes boolean, period_us long, seq long, bid int, ask int, trade int, source string")
    key = lambda r: (str(r.gp), r.topic, r.price_bucket, r.bucket_index, r.n, r.n_markets, round(r.p_yes, 9), round(r.se, 9))
    together = C.rates_by_method(obs, 10, ("a",)).collect()
    for m in C.METHODS:
        alone = C.event_rates(obs.withColumn("price", C.conditioning_price(m, F.col("bid"), F.col("ask"), F.col("trade"))), "price", 10, ("a",)).collect()
        assert alone
        assert sorted(map(key, alone)) == sorted(key(r) for r in together if r.method == m)
