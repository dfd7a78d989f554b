"""Each operator against brute force, SQL or an exact round trip, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import re
import subprocess
import sys
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, exact_dedup, jaccard_join, language, mixing, queries, resampling, token_files, toxicity, warc
from tidemark.llm.textnum import TABLE, stretches
from tidemark.llm.textnum import shingles as _shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, n string, copies int, rep int, good string, label string, _source string, _target double, _rate int, _copies long, _copy int, _drop long, plan int, of_source int, copy int, of_doc int, of_words string, its_words string"


def words(text):
    return (text or "").encode().translate(TABLE).split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named as the operators name theirs."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    texts = [None, "", "", "   ", "...", "A", "a", base, base.upper(), base + " more", long, long + " end", "Ünïcode ŁÓDŹ <|endoftext|> 中文", "a\tb\r\nc", base]
    clash = ("s", 0.5, 1, 2, 3, 4, 5, 6, 7, 8, "w", "i")
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "b", "c"][i % 4], None, "x", "y", 1, 2, "g", None, *clash) for i, t in enumerate(texts)]
    rows += [(None, "one two three", "en", "a", 1, *[None] * 18), rows[7], rows[7]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (7, 1, 0), (7, 1, 1), (None, 1, 1), (10, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


def sql_matches(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["op2_mixing", "op7_exact_dedup", "op10_warc"])
def test_sql(spark, sf, name):
    sql_matches(spark, sf, name)


def test_exact_groups(odd, empty):
    rows = odd.collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[low(r.text)].append(r.doc_id)
    want = sorted((r.doc_id is not None, r.doc_id or 0, max((x for x in groups[low(r.text)] if x is not None), default=None), len(groups[low(r.text)]), hashlib.sha256(low(r.text).encode()).hexdigest()) for r in rows)
    got = exact_dedup.radix_groups(odd, first_width=2, growth=4).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.radix_groups(empty).count() == 0


def test_mixing(odd, empty, spark):
    plan = mixing.mixing_plan(odd).collect()
    assert len(plan) == odd.count() and all(r.taken <= 3 * r.size for r in plan)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == mixing.mix(odd).count()
    assert mixing.mix(empty).count() == 0 and mixing.mixing_plan(empty).count() == 0
    # 10, 100 and 1000 words share 1110 by weights 1, 2, 3: the first two are at their limits
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, size long")
    assert {r.source: r.target for r in mixing.rates(sizes).collect()} == {"a": 30.0, "b": 300.0, "c": 780.0, None: 0.0}


@pytest.mark.parametrize("kind", ["no ids, one text", "no ids", "one id", "ids"])
def test_taken_words_come_near_targets(spark, kind):
    """Sources of 3,000 short rows, also where rows are alike; and of many sources the rates as a plain loop has them."""
    rows = [(i if kind == "ids" else 1 if kind == "one id" else None, f"x{s}", "a b c" if "one" in kind else f"a b c{i}") for s in range(4) for i in range(3000 + 500 * s)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixing_plan(docs).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 4 and all(abs(r.taken - r.target) < 0.05 * r.target for r in got)
    count = lambda: sorted(r["count"] * 3 for r in mixing.mix(docs).groupBy("source").count().collect())
    mixed = count()
    assert mixed == count() and all(abs(x - r.target) < 0.05 * r.target for x, r in zip(mixed, sorted(got, key=lambda r: r.taken), strict=True))


def test_rates_of_many_sources(spark):
    rng = np.random.default_rng(2)
    sizes = {f"s{i:05d}": int(x) for i, x in enumerate(rng.integers(0, 10**6, 3000) ** 2 // 10**6)}
    got = {r.source: r.target for r in mixing.rates(spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(5)).collect()}
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    full, left = set(), None
    while left is None or any(weights[s] * left > 3 * sizes[s] for s in sizes if s not in full):
        if left is not None:
            full |= {s for s in sizes if weights[s] * left > 3 * sizes[s]}
        left = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / sum(weights[s] for s in sizes if s not in full)
    assert got == pytest.approx({s: float(3 * sizes[s]) if s in full else weights[s] * left for s in sizes})


def test_chat(spark):
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, None, None), (3, 0, "assistant", "<\\|x <|end|> [\\ <\\\\|"), (3, 1, "user", "é"), (3, 2, "assistant", ""), (None, None, "user", "x"), (4, 0, "user", "u" * 3_000_000), (4, 1, "user", "v"), (4, 2, "assistant", "w")]
    table = spark.createDataFrame([(*r, "piece") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.round_trip(table).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for conv, turns in by.items():
        replies = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in turns).encode()).hexdigest(), len(replies), hashlib.sha256(replies.encode()).hexdigest())
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want
    spelled = {(r.conv_id, r.seq): r for r in chat.examples(chat.format_turns(table.where("conv_id = 3"))).collect()}
    last = spelled[3, 1]
    assert len(spelled) == 2 and last.loss_start == last.loss_end and last.text.startswith(spelled[3, 0].text)
    first = spelled[3, 0]
    assert chat.unescape(first.text[first.loss_start : first.loss_end]) == rows[3][3]
    assert chat.round_trip(table.limit(0)).count() == 0


def test_token_files(odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    got = sorted(tuple(r)[1:] for r in token_files.round_trip(odd, queries.tokenizer_path()).collect())
    rows = odd.select("doc_id", "text").orderBy("doc_id", F.xxhash64("text")).collect()
    start, want = 0, []
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.round_trip(empty, queries.tokenizer_path()).count() == 0


def test_token_file_is_random_access():
    ids = np.arange(5000, dtype="<u2")
    content = token_files.stream_file(ids.tobytes(), "<u2", {"part": 0}, 512, 4)
    found = list(token_files.sequences(content + b"\n"))
    assert len(found) == 10 and (found[3][0] == np.arange(1536, 2048)).all()
    assert found[9][1].sum() == 5000 - 9 * 512 and not found[3][0].flags.owndata
    sizes = {b.nbytes for b in list(pa.ipc.open_stream(content))[:-1]}
    assert len(sizes) == 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_whole_texts_by_any_tokenizer(spark, name):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    t = Tokenizer.from_file(path)
    texts = ["Hello World, it is fine", "it's 12 <|endoftext|>\n\t é", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()) for x in texts]
    assert [r.ids_crc32 for r in sorted(token_files.round_trip(docs, path).collect())] == want


def test_texts_that_skip_steps_have_the_library_s_ids():
    """Texts of ASCII and Latin letters are only cut and encoded, with the ids of all the file's steps; other texts take the steps, as do those of other tokenizers."""
    import random

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    _, plain, added = token_files._tokenizers(path)
    assert plain.normalizer is None and token_files._tokenizers(queries.tokenizer_path("byte_bpe_50k.json"))[1] is None
    simple = [chr(c) for c in range(0x250) if token_files._prepared(chr(c), added) is not None]
    assert [t.normalizer.normalize_str(f"x{c}x") for c in simple] == [f"x{' ' if c.isspace() else c.lower()}x" for c in simple]
    assert {*"aZ\n '_9éÀßȺ"} <= {*simple} and not {*"\x0b\x85\xa0×ª\u0130\x7f"} & {*simple}
    odd = ["\u0301", "\u0130", "Σ", "–", "日本", "\x0b", "\x85", "\xa0", "×", "<|endoftext|>", "<|ENDOFTEXT|>"]
    assert all(token_files._prepared(f"a{x}", added) is None for x in odd)
    rng = random.Random(1)
    pieces = simple + ["'s", "'RE", "'ll", "''", "12", "&&", "the", "\n\n"] * 5
    texts = [a + b for a in simple for b in simple[:100]]
    texts += ["".join(rng.choices(pieces, k=rng.randrange(80))) for _ in range(5000)] + ["".join(rng.choices(pieces + odd * 3, k=rng.randrange(80))) for _ in range(5000)]
    want = [np.array(e.ids, "<u2").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    assert token_files.encode(path, texts, "<u2") == want


def test_whole_texts_are_merged_as_one():
    """The library gets a text uncut, with the last letters of its words marked, and cuts at white space in a very long one only; the ids are those of all the file's steps."""
    import json
    import random

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    _, _, added = token_files._tokenizers(path)

    def ready(texts):
        return token_files._marked([token_files._prepared(x, added) for x in texts])

    def shown(text):
        return "".join(chr(ord(c) - token_files._LAST) + "|" if ord(c) >= token_files._LAST else c for c in text)

    texts = ["It's", "", "'re", "don't've", " ..'s 'll'd'x ", "rock'n'roll ''t", "a12,5", "'", "'l", "'"]
    assert [shown(x) for x in ready(texts)] == ["it|'s|", "", "'re|", "don|'t|'ve|", "..'|s|'ll|'d|'|x|", "rock|'|n|'|roll|''|t|", "a|1|2|,|5|", "'|", "'|l|", "'|"]
    rng = random.Random(2)
    texts += ["".join(rng.choices([*"aelrstvdm1. é", *"'" * 3], k=n)) for n in range(400) for _ in range(5)]
    long = "\n".join(rng.choices(texts, k=4000))
    texts += [long, "x" * 70_000, long.replace(" ", "").replace("\n", "")]
    assert sum(" " in x for x in ready(texts)) < 20 and 8 <= ready([long])[0].count(" ") <= len(long.encode()) // token_files._PIECE
    assert token_files.encode(path, texts, "<u2") == [np.array(e.ids, "<u2").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    assert token_files._with_last_letters(model) and token_files._with_last_letters(model | {"ignore_merges": True}) is None
    assert token_files._with_last_letters(model | {"merges": [*model["merges"], ["e</w>", "x"]]}) is None
    assert token_files._with_last_letters(model | {"vocab": {w: i for w, i in model["vocab"].items() if w != "e</w>"}}) is None


def test_warc(spark):
    big = "x" * 1500
    rows = [(1, "http://www.B.com/p?q#f", big), (5, None, big), (3, "https://b.com:80/p?q", big), (5, "u%0Av\r\nw", big), (2, "http://a.org", None), (4, "http://a.org", "small"), (6, "http://a.org", "small"), (None, "http://z", "né\r\n\r\nWARC/1.1\r\n")]
    table = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.capture_histories(table).collect()
    assert [(r.urlkey, r.captured) for r in got] == sorted((r.urlkey, r.captured) for r in got)
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted((p or 0, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and p != 5 else "response", 5 if h == big and p != 5 else None) for p, _, h in rows)
    assert {r.page_id: r.url for r in got}[4] == "http://a.org" and sum(r.urlkey == "com,b)/p?q" for r in got) == 2
    assert warc.capture_histories(table.limit(0)).count() == 0


def test_index_entries_cut_records_out_of_the_archives(spark, tmp_path):
    """Place and length of an entry give its record by one gzip member; the archive is a gzip file as it stands, also where its last record has 16 MB."""
    import gzip

    rows = [(1, "http://a/x", "one"), (2, "http://a/y", "z" * (17 << 20)), (3, "http://a/z", "three" * 500), (3, "http://a/w", "three" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), archive_bytes=1 << 14)
    index = warc.read_index(spark, str(tmp_path / "w")).collect()
    assert [r.url for r in index] == ["http://a/w", "http://a/x", "http://a/y", "http://a/z"] and len({r.run for r in index}) == 2
    ids = set()
    for r in index:
        content = open(r.run.removeprefix("file:"), "rb").read()
        header, block = warc.record(gzip.decompress(content[r.at : r.at + r.length]))
        assert header["WARC-Target-URI"] == r.url and hashlib.sha1(block).hexdigest() == r.payload_digest
        assert gzip.decompress(content).count(b"WARC/1.1\r\n") == sum(x.run == r.run for x in index)
        ids.add(header["WARC-Record-ID"])
    assert len(ids) == 4


def test_loser_tree():
    rng = np.random.default_rng(3)
    for k in range(9):
        runs = [sorted(rng.integers(0, 20, rng.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.merged(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def near_by_force(rows):
    sets = []
    for r in rows:
        w = words(r.text) if r.doc_id is not None else []
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    common = defaultdict(int)
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            parent[x if rows[x].doc_id > rows[y].doc_id else y] = y if rows[x].doc_id > rows[y].doc_id else x
    return sorted((r.doc_id is not None, r.doc_id or 0, rows[find(k)].doc_id, links[k]) for k, r in enumerate(rows))


def test_jaccard_join(spark, sf, odd, empty):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = docs.collect()
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.class_id, r.n_links) for r in jaccard_join.similarity_join(docs).collect())
        assert got == near_by_force(rows)
    assert jaccard_join.similarity_join(empty).count() == 0
    kept = jaccard_join.one_of_each_class(odd)
    assert kept.columns == odd.columns


def test_prefixes_are_shortened(spark):
    """Pairs of similarity 45 / 56, two of which share no node at the full depth and one none at a hash less: all are linked."""
    rows = []
    for k, i in enumerate([413, 620, *range(20)]):
        base = [f"p{i}w{x}" for x in range(49)]
        rows += [(2 * k, " ".join(base + [f"a{i}x{x}" for x in range(5)])), (2 * k + 1, " ".join(base + [f"b{i}x{x}" for x in range(6)]))]
    got = jaccard_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(d, d - d % 2, 1) for d in range(44)]


def test_shortening_finds_what_full_labels_miss(spark):
    """A pair that shares its first six hashes of one tree, and seven of none, meets at the target of the library and not at one that full labels reach."""
    assert [jaccard_join.shortest(t) for t in (0.99, 0.999, 0.9999, 0.99999)] == [8, 7, 6, 5]
    rng = np.random.default_rng(9)
    one = rng.integers(0, 1 << 16, jaccard_join.HASHES).astype(np.uint16)
    two = one.copy()
    two[6 :: jaccard_join.DEPTH] ^= 1
    two[5 :: jaccard_join.DEPTH] ^= np.where(np.arange(jaccard_join.TREES) == 3, 0, 1).astype(np.uint16)
    noise = rng.integers(0, 1 << 16, (50, jaccard_join.HASHES)).astype(np.uint16)
    rows = [(i, x.tobytes()) for i, x in enumerate([one, two, *noise])]
    reps = spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "rep long, sig binary")
    for target, want in ((0.9999, [(0, 1)]), (0.999, []), (0.99, [])):
        assert [tuple(sorted(r)) for r in jaccard_join.near_links(reps, target).collect()] == want


def test_tries_over_many_tasks(spark):
    """Every pair that shares a prefix in a tree is in one node, however the sorted labels are cut."""
    rng = np.random.default_rng(10)
    sig = rng.integers(0, 3, (200, jaccard_join.HASHES)).astype(np.uint16)
    label = [[(bytes([t]) + s.reshape(jaccard_join.TREES, -1)[t].astype(">u2").tobytes()) for t in range(jaccard_join.TREES)] for s in sig]
    want = set()
    by = defaultdict(set)
    for i, labels in enumerate(label):
        for x in labels:
            by[x[: 1 + 2 * 6]].add(i)
    for found in by.values():
        if len(found) > 1:
            want.add(frozenset(found))
    reps = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "rep long, sig binary")
    for parts in (1, 7):
        rows = reps.mapInArrow(jaccard_join._labels, "rep long, label binary").repartitionByRange(parts, "label", "rep").sortWithinPartitions("label", "rep").mapInArrow(jaccard_join._matched(6), "rep long, node long, rest long").collect()
        nodes = defaultdict(set)
        for r in rows:
            nodes[r.node].add(r.rep)
        assert {frozenset(x) for x in nodes.values() if len(x) > 1} == want


def test_node_levels():
    """Links of a node equal those of comparing all its pairs, as components."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 256, (5, jaccard_join.HASHES)).astype(np.uint8)
    sketch = base[rng.integers(0, 5, 60)]
    noisy = rng.random(sketch.shape) < rng.random((60, 1)) * 0.25
    sketch = np.where(noisy, rng.integers(0, 256, sketch.shape), sketch).astype(np.uint8)
    rest = np.sort(rng.integers(0, 3, 60) << 16 | rng.integers(0, 3, 60))
    label = jaccard_join.link_node(sketch, rest, 2)
    near = (sketch[:, None] == sketch[None]).sum(2) >= np.ceil(jaccard_join.NEAR * jaccard_join.HASHES)
    pairs = np.argwhere(near)
    want = jaccard_join._spanning([(pairs[:, 0], pairs[:, 1])], 60)
    assert (label == want).all() and len(set(want.tolist())) < 60


def test_words_of_one_polynomial_hash_stay_apart(spark):
    """Two words of 1,024 letters, one the other's complement in the Thue-Morse order, collide in every polynomial modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits))]
    got = jaccard_join.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 0), (2, 2, 0)]


def test_shingles_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(jaccard_join, "shingles", lambda w, n: (lambda v, f: (v % np.uint64(3), f))(*_shingles(w, n)))
    sets = jaccard_join.numbered([b"a b c d e f", b"a b c d e g", b"x"])
    assert [len(s) for s in sets] == [2, 2, 1] and len(set(sets[0]) & set(sets[1])) == 1 and not set(sets[2]) & set(sets[0])


def test_one_row_of_each_class_stays(spark):
    """Rows that repeat a doc_id are decided each by its words."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base, "more"])
    rows = [(1, " ".join(base), "x"), (1, " ".join(base).upper(), "y"), (1, "something else", "z"), (2, near, "x"), (3, None, None), (None, near, None), (2, "only this", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of_doc string")
    got = jaccard_join.one_of_each_class(docs).collect()
    # either of the rows 1 with the same words stays, or, if its digest is less, none but it
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in got) == sorted([(0, near), (1, " ".join(base)), (1, "something else"), (2, "only this"), (3, "")])


def test_digest_in_columns_equals_signing(odd):
    signed = {r.rid: r.same for r in jaccard_join.sign(odd.coalesce(1)).collect()}
    columns = {r.rid: r.same for r in odd.coalesce(1).select(F.monotonically_increasing_id().alias("rid"), jaccard_join.same_words(F.col("text")).alias("same")).collect()}
    assert signed == columns


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    """More near copies than a block holds: every link is counted once."""
    monkeypatch.setattr(jaccard_join, "LEAST", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 50 + 5], f"new{i}", *base[i % 50 + 5 :]])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((True, r.doc_id, r.class_id, r.n_links) for r in jaccard_join.similarity_join(docs).collect())
    assert got == near_by_force(docs.collect())


def test_decontamination(spark, odd, empty):
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"t{i:03d}" for i in range(600)])
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=np.arange(600, 0, -1) / 180300))
    items = [(i, text(int(rng.integers(15, 55)))) for i in range(20)] + [(98, None), (99, "")]
    docs = [(i, text(int(rng.integers(1, 400)))) for i in range(300)]
    for i in range(0, 20):
        changed = items[i][1].split()
        for k in range(2, len(changed) - 6, 8):
            changed[k] = "other"
        docs.append((1000 + i, f"{text(30 + 7 * i)} {items[i][1] if i % 2 else ' '.join(changed)} {text(40)}"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, benchmark).collect()}
    assert got == {(1000 + i, i) for i in range(20)}
    assert decontaminate.without_leaks(frame, benchmark).count() == 300
    assert decontaminate.leaks(odd, benchmark).count() == 0 and decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(frame, benchmark.limit(0)).count() == 0


def test_short_and_rewritten_items(spark):
    """Items of 15 to 24 words with up to 45% of their words replaced but the answer kept, wherever the windows fall: none is lost."""
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"t{i:03d}" for i in range(600)])
    text = lambda n: rng.choice(vocabulary, n, p=np.arange(600, 0, -1) / 180300).tolist()
    items, docs = [], []
    for i in range(200):
        item = text(15 + i % 10)
        items.append((i, " ".join(item)))
        changed, most = list(item), int(0.45 * len(item))
        for k in rng.choice(len(item) - 5, most, replace=False):
            changed[k] = text(1)[0]
        docs.append((i, " ".join(text(40 + i % 12) + (changed if i % 4 else item) + text(60))))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert got == {(i, i) for i in range(200)}


def spread_items(extra, n=60, words_of=40):
    """Items, each spread through a text with so many common words after each of its own, and background texts."""
    rng = np.random.default_rng(21)
    vocabulary = np.array([f"t{i:04d}" for i in range(4000)])
    weight = 1 / np.arange(1, 4001)
    text = lambda k: rng.choice(vocabulary, k, p=weight / weight.sum()).tolist()
    items = [text(words_of) for _ in range(n)]
    docs = [(i, " ".join([*text(30), *[y for x in item for y in [x, *vocabulary[rng.integers(0, 30, extra)]]], *text(30)])) for i, item in enumerate(items)]
    docs += [(1000 + i, " ".join(text(int(rng.integers(20, 400))))) for i in range(1500)]
    return [(i, " ".join(x)) for i, x in enumerate(items)], docs


@pytest.mark.parametrize("extra", [0, 1, 2])
def test_spread_items_are_found(spark, extra):
    """Recall of the search against the check's own definition on items spread over up to three times their words."""
    items, docs = spread_items(extra)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, benchmark).collect()}
    assert got == {(i, i) for i in range(60)}


def leaks_by_force(docs, items):
    """All stretches of all texts against all items, by the definition of the check."""
    found = set()
    for item_id, text in items:
        item = words(text)
        n = len(item)
        for doc_id, body in docs:
            w = words(body)
            if not n or len(set(item) & set(w)) < 0.3 * len(set(item)):
                continue
            for begin in range(len(w)):
                if w[begin] in item:
                    part = w[begin : begin + decontaminate.SPREAD * n]
                    number = {x: k for k, x in enumerate({*item, *part})}
                    share = decontaminate.common_subsequence(np.array([number[x] for x in item]), np.array([number[x] for x in part])) / n
                    answer = item[-decontaminate.ANSWER :]
                    whole = any(part[k : k + len(answer)] == answer for k in range(len(part) - len(answer) + 1))
                    if share >= decontaminate.COVERED or share >= decontaminate.PARAPHRASED and whole:
                        found.add((doc_id, item_id))
                        break
    return found


def test_leaks_against_all_pairs(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    want = leaks_by_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and want


def test_leaks_in_a_very_long_text():
    """A text of 64 MB, searched in less than 1 GB; items wherever stretches end, and one spread over three times its words."""
    code = """
import resource, sys
import numpy as np, pyarrow as pa
from tidemark.llm import decontaminate as d
rng = np.random.default_rng(4)
background = rng.choice([f"t{i:04d}" for i in range(4000)], 11_300_000)
items = [" ".join(rng.choice([f"q{i:03d}" for i in range(900)], 40)) for _ in range(24)]
for k, item in enumerate(items[:-1]):
    at = 470_000 * k + 88_000 + 37 * k
    background[at : at + 40] = item.split()
background[11_300_000 - 130 : 11_300_000 - 11 : 3] = items[-1].split()
text = " ".join(background)
del background
assert len(text) > 64 << 20
rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
del text
frequency = np.ones(d.TERMS, np.int64)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
list(d._gather(iter([rows])))
table = np.random.default_rng(1).standard_normal((d.TERMS, d.FACTORS)).astype(np.float32)
found = [f for _, f in d.search_rows(d.Items(list(range(24)), items, table, frequency), d._with_none(table), iter([rows]))]
after = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert sorted(x[1] for x in found[0]) == list(range(24)), found
assert after - before < 500_000, after - before
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=600)


def test_stretches():
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = b" ".join(b"x" * int(k) for k in rng.integers(0, 9, int(rng.integers(0, 80))))
        limit, span = int(rng.integers(1, 60)), int(rng.integers(0, 5))
        cut = list(stretches(text, limit, span))
        at = [(m.start(), m.end()) for m in re.finditer(rb"x+", text)]
        assert cut[0][0] == 0 and cut[-1][1] == len(text)
        for k in range(len(at)):
            last = at[min(len(at), k + max(span, 1)) - 1][1]
            assert any(a <= at[k][0] and last <= b for a, b in cut)


@pytest.mark.parametrize(("extra", "rewritten", "least"), [(0, 0, 1.0), (0, 8, 0.9), (1, 0, 0.9)])
def test_latent_search_alone(spark, monkeypatch, extra, rewritten, least):
    """The share of leaks that the cosines find without the exact way, of whole items, of items with an eighth of their words replaced, and of items spread over twice their words. Those spread over three times are diluted in every window: there the exact way is needed."""
    monkeypatch.setattr(decontaminate, "close_keys", lambda items, w: (np.zeros(0, int),) * 4)
    items, docs = spread_items(extra)
    rng = np.random.default_rng(8)
    for i, (key, body) in enumerate(docs[:60]):
        changed = body.split()
        for k in rng.choice(np.arange(30, len(changed) - 45), len(changed) // rewritten if rewritten else 0, replace=False):
            changed[k] = "other"
        docs[i] = (key, " ".join(changed))
    table, frequency = decontaminate.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    by_hand = decontaminate.Items([i for i, _ in items], [t for _, t in items], table, frequency)
    rows = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    found = {(rows.column(0)[d].as_py(), i) for rows, hits in decontaminate.search_rows(by_hand, decontaminate._with_none(table), iter([rows])) for d, i, *_ in hits}
    want = leaks_by_force(docs[:60], items)
    assert found <= want and len(found) >= least * len(want) and len(want) == 60


def test_leaks_row_by_row(spark):
    """Repeated items and rows are reported each; rows that repeat a doc_id stay or go by their own text."""
    item = " ".join(f"t{i}" for i in range(20))
    benchmark = spark.createDataFrame([(7, item), (7, item), (None, item)], "item_id long, text string")
    rows = [(1, f"a b {item} c", 1), (1, "clean", 2), (None, item, 3), (2, f"{item} x", 4), (2, f"{item} x", 5), (3, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _drop int")
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in decontaminate.leaks(docs, benchmark).collect())
    assert got == sorted((d, i) for d in (1, 0, 2, 2) for i in (7, 7, 0))
    assert sorted(r._drop for r in decontaminate.without_leaks(docs, benchmark).collect()) == [2, 6]


def test_each_region_is_decided_alone(spark):
    """A part of 0.56 with the answer is a leak, though another of 0.6 without it is in the same text."""
    rng = np.random.default_rng(12)
    filler = lambda n: [f"f{x}" for x in rng.integers(0, 5000, n)]
    item = [f"t{i}" for i in range(25)]
    smaller, larger = item[11:], item[:15]
    docs = [(1, " ".join(filler(40) + smaller + filler(200) + larger + filler(40))), (2, " ".join(filler(40) + larger + filler(40)))]
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert [(r.doc_id, r.item_id, r.covered, r.answer) for r in got] == [(1, 7, 0.56, True)]


def test_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(0, 40))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == table[-1, -1]


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.predict_languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in got if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) > 0.97
    rows = language.predict_languages(odd).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (0, 1, 3, 4)} == {"und"}
    assert language.predict_languages(empty).count() == 0


def plain_gru(inputs, u, back):
    """A gated recurrent layer, one step and one text at a time."""
    hidden = u.shape[1]
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, out = np.zeros(hidden), [None] * len(inputs)
    for t in range(len(inputs))[:: -1 if back else 1]:
        z, r = sig(inputs[t][:hidden] + u[:hidden] @ h), sig(inputs[t][hidden : 2 * hidden] + u[hidden : 2 * hidden] @ h)
        n = np.tanh(inputs[t][2 * hidden :] + r * (u[2 * hidden :] @ h))
        h = out[t] = (1 - z) * n + z * h
    return np.array(out)


def test_language_network_against_a_plain_loop():
    rng = np.random.default_rng(8)
    texts = ["a", "some text of more than sixty-four bytes, so that it is read in pieces of which each starts anew", "é" * 40, ""]
    sample = [(lang, bytes(rng.integers(97, 120, language.SPAN).astype(np.uint8)), int(rng.integers(1, 65))) for lang in "xyz" for _ in range(20)]
    model = language.fit(sample)
    got = language.document_probabilities(model, *language.flat(pa.array(texts)))
    for text, probabilities in zip(texts, got, strict=True):
        raw, sums = text.encode(), np.zeros(3)
        for at in range(0, len(raw), language.SPAN):
            piece = list(raw[at : at + language.SPAN])
            h = [plain_gru(model[f"in_{s}"][:, piece].T.astype(float), model[f"u_{s}"].astype(float), s == "b") for s in "fb"]
            for a, b in zip(*h, strict=True):
                e = np.exp(model["out"] @ np.r_[a, b] + model["bias"][:, 0])
                sums += e / e.sum()
        assert np.allclose(probabilities, sums / max(1, len(raw)), atol=1e-4)


def test_toxicity_network_against_a_plain_loop():
    """Scores of whole texts from the model's numbers, with words, n-grams, windows and steps one by one."""
    rng = np.random.default_rng(7)
    model = toxicity.initial(3) | {"word": rng.standard_normal(1 << toxicity.WORD_BITS).astype(np.float32), "gram": rng.standard_normal(1 << toxicity.GRAM_BITS).astype(np.float32)}
    model["embed"] *= 20
    texts = ["", "one two", " ".join(f"word{i % 7}s" for i in range(75)), "ab " * 40 + "strange-words everywhere"]
    got = toxicity.scores(model, pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        rows = []
        for x in words(text):
            padded = b" " + x + b" "
            one = toxicity.Words(np.frombuffer(padded, np.uint8), np.array([0, len(padded)]))
            bucket = int(one.hash[0] >> np.uint64(64 - toxicity.WORD_BITS))
            values, chars = [], []
            for size in toxicity.GRAMS:
                for k in range(len(padded) - size + 1):
                    g = int((one.spans(np.array([k]), np.array([k + size]))[0] + np.uint64(size)) >> np.uint64(64 - toxicity.GRAM_BITS))
                    values.append(model["gram"][g])
                    if size == toxicity.GRAMS[0]:
                        chars.append(model["chars"][:, g >> (toxicity.GRAM_BITS - toxicity.CHAR_BITS)])
            rows.append(np.r_[model["word"][bucket], max([0, *values]), np.mean(values) if values else 0, model["embed"][:, bucket], np.mean(chars, 0) if chars else np.zeros(toxicity.CHARS)])
        worst, at = -np.inf, 0
        while True:
            x = np.array(rows[at : at + toxicity.WINDOW]).reshape(-1, toxicity.INPUTS)
            h = np.concatenate([plain_gru(x @ model[f"w_{s}"].T + model[f"c_{s}"][:, 0], model[f"u_{s}"].astype(float), s == "b").reshape(len(x), toxicity.HIDDEN) for s in "fb"], axis=1)
            a = np.exp(np.tanh(h @ model["att"].T) @ model["pick"]) if len(x) else np.zeros(0)
            pooled = (a / a.sum()) @ h if len(x) else np.zeros(2 * toxicity.HIDDEN)
            worst = max(worst, model["out"] @ pooled + model["bias"][0])
            if at + toxicity.WINDOW >= len(rows):
                break
            at += toxicity.STRIDE
        assert abs(score - 1 / (1 + np.exp(-worst))) < 1e-4


def test_odds_of_a_sample(spark):
    """The counts of all tasks, slice by slice, against a plain count of the texts with each word."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, 12)) for _ in range(80)]
    rows = [(t, int(i % 3 == 0), int(i % 2), i) for i, t in enumerate(texts)]
    tables = toxicity.tables_from(spark.createDataFrame(rows, "text string, toxic int, half int, row long").repartition(3))
    for table, halves in zip(tables, ([0], [1], [0, 1]), strict=True):
        some = [r for r in rows if r[2] in halves]
        for x in range(30):
            has = [r for r in some if f"w{x}" in r[0].split()]
            pos, neg, all_pos = sum(r[1] for r in has), sum(1 - r[1] for r in has), sum(r[1] for r in some)
            want = np.log((pos + 1) / (all_pos + 2)) - np.log((neg + 1) / (len(some) - all_pos + 2)) if pos + neg >= toxicity.SEEN else 0
            w = toxicity.Words(np.frombuffer(f"w{x}".encode(), np.uint8), np.array([0, len(f"w{x}")]))
            assert abs(table["word"][int(w.hash[0] >> np.uint64(64 - toxicity.WORD_BITS))] - np.clip(want, -4, 6)) < 1e-5


def test_toxicity(spark, odd, empty, labels):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in marks.collect()}
    held = toxicity.score_documents(docs.where("doc_id < 6000"), marks).where("held_out").collect()
    score, truth = np.array([(r.score, toxic[r.doc_id]) for r in held if r.doc_id in toxic]).T
    ranks = np.argsort(np.argsort(score))
    positives = truth.sum()
    assert (ranks[truth == 1].mean() - (positives - 1) / 2) / (len(truth) - positives) > 0.9
    assert toxicity.score_documents(odd, labels).count() == odd.count()
    assert {r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.without_toxic(odd, labels).columns == odd.columns


def test_gradients():
    """Backpropagation through time against differences."""
    from tidemark.llm import gru

    rng = np.random.default_rng(2)
    u, x = rng.standard_normal((9, 3)), rng.standard_normal((4, 9, 2))
    value = lambda: float((gru.forward(x, u).astype(float) ** 2).sum())
    kept = []
    states = gru.forward(x, u, keep=kept)
    d_x, d_u = gru.backward(2 * states, u, kept)
    for array, grad in ((x, d_x), (u, d_u)):
        for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(6)]:
            old = array[at]
            array[at] = old + 1e-2
            up = value()
            array[at] = old - 1e-2
            assert abs((up - value()) / 2e-2 - grad[at]) < 2e-2
            array[at] = old


def test_resampling(spark, sf, odd, empty, labels):
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = resampling.resample(docs, marks, share=0.3).collect()
    keys = sorted((r.gumbel_key for r in rows), reverse=True)
    k = round(len(rows) * 0.3)
    assert sum(r.selected for r in rows) == k and {r.selected for r in rows if r.gumbel_key >= keys[k - 1]} == {True}
    quality = {r.doc_id: r.quality for r in marks.collect()}
    mean = lambda q: np.mean([r.log_weight for r in rows if quality.get(r.doc_id) == q])
    assert mean(1) > mean(0)
    assert resampling.resample(odd, labels).count() == odd.count()
    assert resampling.resample(empty, labels).count() == 0


def test_resampling_by_force(spark, odd, labels):
    """Weights from plain counts of words and word pairs by bucket, keys from a plain Gumbel draw, and the largest of them; rows without a doc_id draw apart."""
    import re
    from collections import Counter

    rng = np.random.default_rng(13)
    rows = [(i if i % 5 else None, " ".join(f"w{x}" for x in rng.integers(0, 40, int(rng.integers(0, 30)))) + (" !? x" if i % 3 else "")) for i in range(200)]
    marks = spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(200)], "doc_id long, quality int")
    docs = spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, draw string")
    got = resampling.resample(docs, marks, share=0.25).collect()

    def buckets(text):
        parts = re.findall(r"[0-9A-Za-z]+|[^0-9A-Za-z\s]+", text.lower())
        h = [int(resampling.Words(np.frombuffer(p.encode(), np.uint8), np.array([0, len(p)]), True).hash[0]) for p in parts]
        two = [int(resampling.mix(np.array([(a * 0xD6E8FEB86659FD93 + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
        return [x >> 50 for x in h + two]

    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(buckets(t))
        if d is not None and d % 4 == 1:
            target.update(buckets(t))
    model = lambda c, b: np.log((c[b] + 1) / (sum(c.values()) + resampling.BUCKETS))
    want = sorted(sum(model(target, b) - model(raw, b) for b in buckets(t)) for _, t in rows)
    assert np.allclose(sorted(r.log_weight for r in got), want)
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert {r.gumbel_key for r in got if r.selected} == set(keys[:50])
    nulls = [round(r.gumbel_key - r.log_weight, 9) for r in got if r.doc_id is None]
    assert len(set(nulls)) == len({t for d, t in rows if d is None}) > 30


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "benchmark decontamination", "mixing", "token output"]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    want = sum(d[1] == d[2] for d in near_by_force(docs.collect()))
    assert kept.count() == want and kept.columns == docs.columns
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_pipeline_on_odd_tables(request, spark, odd, labels, tmp_path, name):
    """All stages, one after the other, on nulls, repeats, long texts and clashing names, and on an empty table."""
    import corpus_pipeline

    docs = request.getfixturevalue(name)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (stage, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = step(spark, now, str(tmp_path))
        assert out.columns == docs.columns, stage
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) == now.count()
    if name == "odd":
        left = [r.text for r in spark.read.parquet(f"{tmp_path}/2").collect()]
        assert not any("one two three four five six seven" in (t or "").lower() for t in left) and left.count("") == 2
        # the null one, the empty ones, those without letters, the one without an id and one of each class are there
        assert sorted(t or "" for t in left if len(t or "") < 50) == sorted(["", "", "", "   ", "...", "A", "Ünïcode ŁÓDŹ <|endoftext|> 中文", "a\tb\r\nc", "one two three"])
    else:
        assert not rows


def test_pipeline_stages_by_force(spark, sf, tmp_path):
    """What the stages keep of a whole table, against brute force for near duplicates and leaks, and what the token files then hold."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    classes = {d[1]: d[2] for d in near_by_force(docs.collect())}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in classes.values()})
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaking = {d for d, _ in leaks_by_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])}
    clean = corpus_pipeline.drop_leaks(spark, docs, sf)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(classes) - leaking)
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    taken = {r.doc_id: r.taken // r.size for r in mixing.mixing_plan(docs).collect() if r.size}
    from collections import Counter

    assert {d: n for d, n in Counter(r.doc_id for r in mixed.collect()).items() if d in taken} == {d: n for d, n in taken.items() if n}
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted((r.doc_id, zlib.crc32(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in mixed.collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in corpus_pipeline.write_tokens(spark, mixed, sf).collect()) == want
