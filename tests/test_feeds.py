"""Documents, logs and payloads with parts that are missing or damaged, windows to fetch, and books."""

import datetime
import json
import zlib

from pyspark.sql import functions as F

from tidemark.operators import intervals as I
from tidemark.operators import virtual as V
from tidemark.sources import parsers as P
from tidemark.sources import payloads as Z


def test_fenced_answers(spark):
    cases = [
        ('{"a": "x"}', "x"), ('```json\n{"a": "x"}\n```', "x"), ('So:\n```\n{"a": "x"}\n```\nand {"a": "y"}', "x"), ('it is {"a": "x"}, I think', "x"),
        ('```json\n{"a": "x"', None), ("none", None), ("", None), (None, None), ('{"a": {"b": 1}}', '{"b":1}'), ('{"b": 1}', None), ('{"a": "x" oops}', None), ("``````", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", P.fenced_json(F.col("t"), "a string")["a"].alias("a")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_payloads_come_back_and_damaged_ones_are_null(spark):
    texts = ["", "a", "é" * 10, "x" * 3_000_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", Z.packed(F.encode("t", "utf-8")).alias("raw"))
    back = {r.i: r.t for r in rows.select("i", F.decode(Z.unpacked("raw"), "utf-8").alias("t")).collect()}
    assert back == dict(enumerate(texts))
    assert max(len(r.raw) for r in rows.where("i < 4").collect()) < 10_000
    whole = zlib.compress(b"payload")
    bad = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(whole[:-3])), (3, bytearray(b"payload")), (4, bytearray())], "i int, raw binary")
    assert {r.i: r.t and bytes(r.t) for r in bad.select("i", Z.unpacked("raw").alias("t")).collect()} == {1: b"payload", 2: None, 3: None, 4: None}


def test_days_to_fetch(spark):
    day = datetime.date
    spans = spark.createDataFrame([("a", day(2024, 1, 1), day(2024, 1, 4)), (None, day(2024, 2, 28), day(2024, 3, 1)), ("b", day(2024, 1, 2), day(2024, 1, 1)), ("c", None, day(2024, 1, 1))], "k string, first date, last date")
    done = spark.createDataFrame([("a", day(2024, 1, 2)), ("a", day(2024, 1, 2)), ("a", day(2030, 1, 1)), (None, day(2024, 2, 29)), ("a", None)], "k string, day date")
    got = sorted(((r.k, r.day) for r in I.days_to_fetch(spans, done, ["k"]).collect()), key=str)
    assert got == sorted([("a", day(2024, 1, 1)), ("a", day(2024, 1, 3)), ("a", day(2024, 1, 4)), (None, day(2024, 2, 28)), (None, day(2024, 3, 1))], key=str)
    assert I.days_to_fetch(spans, done.limit(0), ["k"]).count() == 7 and I.days_to_fetch(spans.limit(0), done, ["k"]).count() == 0


def test_option_chains_with_parts_missing(spark):
    body = '{"data": {"options": [{"option": "SPXW240119C04500000", "bid": "1.5", "iv": "x"}, {"option": "SPY240119C04500000", "bid": null}, {}]}}'
    df = spark.createDataFrame([(1, body), (2, '{"data": {"options": []}}'), (3, body[:-4]), (4, None), (5, "[]")], "k int, body string")
    got = [(r.k, r.option, r.expiry, r.kind, r.strike, r.bid, r.iv) for r in P.options_chain(df.where("k <> 3"), "body", "k").collect()]
    assert got == [(1, "SPXW240119C04500000", datetime.date(2024, 1, 19), "call", 4500.0, 1.5, None), (1, "SPY240119C04500000", None, None, None, None, None), (1, None, None, None, None, None, None)]
    assert all(r.k == 3 for r in P.options_chain(df.where("k = 3"), "body", "k").collect())


def test_book_features_of_short_and_missing_ladders(spark):
    rows = [(1, [(50, 7), (50, 1), (48, 2)], [], "yes", 50), (2, [(50, 7)], [(40, 3)], "no", 41), (3, [], None, "yes", 50), (4, [], None, "no", 50)]
    df = spark.createDataFrame(rows, "i int, yes array<struct<price:int,quantity:int>>, no array<struct<price:int,quantity:int>>, side string, lim int")
    found = V.book_features(F.col("yes"), F.col("no"), F.col("side"), F.col("lim"))
    got = {r.i: (r.at_limit, r.better, r.depth, r.gap) for r in df.select("i", *[c.alias(n) for n, c in found.items()]).collect()}
    assert got == {1: (8, 0, 10, 0), 2: (0, 0, 3, 1), 3: (0, 0, 0, None), 4: (None, None, None, None)}


def test_settlement_log_with_lines_cut_off(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"action":"settlement","ticker":"a","won":true,"pnl_cents":5}\n{"action":"placed","ticker":"b"}\n{"action":"settlement","ticker":\n\nnot json\n{"action":"settlement","ticker":"c","pnl_cents":"x"}\n{"ticker":"d"}\n')
    assert [r.ticker for r in P.settlement_log(spark, str(path)).collect()] == ["a"]


def test_strikes_longer_than_a_symbol(spark):
    """Nine digits of a strike don't fit a symbol; the strike that is stated beside it counts, one that is no number doesn't."""
    option = lambda symbol, **more: {"option": symbol, "bid": "1", **more}
    body = json.dumps({"data": {"options": [option("SPXW270618C10955200", strike="109552.0"), option("SPXW270618C00080500"), option("SPXW270618P00080500", strike="--")]}})
    got = P.options_chain(spark.createDataFrame([(body,)], "body string"), "body").collect()
    assert [(r.option, r.strike) for r in got] == [("SPXW270618C10955200", 109552.0), ("SPXW270618C00080500", 80.5), ("SPXW270618P00080500", 80.5)]
