"""Operators on the structure of conversations and on shards, against SQL and brute force."""

import functools
import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tidemark.llm import prefix_trie, queries, sharding, structure_repair

TURNS = "conv_id long, turn long, role string, text string, key string, block int, pos int, part int, h int"
CLASH = ("k", 1, 2, 3, 4)


@pytest.mark.parametrize("name", ["op11_structure_repair", "op13_prefix_trie"])
def test_sql(spark, sf, name):
    got = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def plain_trie(rows, every=None):
    """All prefixes of all conversations, one by one."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            t = (role or "", text or "")
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(t[0])}:{t[0]}{t[1]}".encode()).digest()[:16], t))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if every else 0
        built[c] = (own.get(c - int(c - every * int(c / every)), [])[:h] if every else []) + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, convs in members.items():
        tree = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in convs if len(built[c]) == len(path))
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[:-1] == p for q in members)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in tree if p)
        kids = sum(len(q) == len(path) + 1 for q in tree)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), kids, sum(map(leaf, tree)), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("convs", "turns", "seed"), [(1, 3, 0), (1, 9, 1), (2, 9, 2), (7, 5, 3), (20, 200, 4)])
def test_trie_by_blocks(spark, convs, turns, seed):
    """Blocks of few conversations, so that many nodes cross them."""
    draw = random.Random(seed)
    rows = []
    for c in range(160):
        kind = draw.random()
        n = 30 if kind > 0.97 else draw.randrange(1, 7)
        rows += [(c * 7 - 50, draw.choice([None, t, t]), draw.choice("ua"), draw.choice(["", "x", "yé"]) if kind > 0.3 else "same") for t in range(n)]
    rows += [(None, 1, "user", "x"), (5000, 0, None, None), (5000, 0, None, None), (-300, 2, "user", "𝄞")]
    table = spark.createDataFrame([(*r, *CLASH) for r in rows], TURNS).repartition(3)
    for every in (None, 100):
        got = sorted((tuple(r) for r in prefix_trie.conversation_trie(table, every, block_convs=convs, block_turns=turns).collect()), key=str)
        assert got == plain_trie(rows, every)


def test_trie_of_nothing_and_of_turnless(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.conversation_trie(empty, 100).count() == 0
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    table = spark.createDataFrame([(lone, 0, "user", "x", *CLASH)], TURNS)
    root = prefix_trie.conversation_trie(table, 100).collect()
    assert [tuple(r) for r in root] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_trie_of_long_and_many_equal(spark):
    """A conversation of 30,000 turns, and 3,000 copies of one."""
    rows = [(1, t, "user", f"w{t}", *CLASH) for t in range(30_000)] + [(c, 0, "user", "same", *CLASH) for c in range(10, 3010)]
    nodes = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS), block_convs=100)
    root = nodes.where("depth = 0").collect()[0]
    assert nodes.count() == 30_002 and (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (3001, 2, 2, 2999 * 4)
    copies = nodes.where("conv_id = 10").collect()[0]
    assert copies.ends_sha256 == hashlib.sha256(",".join(map(str, range(10, 3010))).encode()).hexdigest()


def plain_repair(rows):
    """All edits, from the first row on: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of rows (turn, role, text)."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for s in set(follows[state]) - {"s"}:
                cost, edits, made = best(i, s, inserted + 1)
                found.append((cost + 2, "I" + edits, (names[s] + ":", *made)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, edits, made = best(i + 1, state, 0)
            found.append((cost + 3, "D" + edits, made))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                for s in follows[state]:
                    cost, edits, made = best(i + 1, s, 0)
                    if role[:1] == s:
                        found.append((cost + more, "K" + edits, (f"{role}:{text}", *made)))
                    if s != "s":
                        found.append((cost + more + 2, "R" + edits, (f"{names[s]}:{text}", *made)))
        return min(found) if found else (10**9, "", ())

    cost, audit, made = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def test_repair(spark):
    draw = random.Random(5)
    rows, want = [], {}
    texts = ["a.", "b!", "c", "", " \t", "d.\u2028", "e. \n", "日本。", "a."]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    for conv in [None, *range(300)]:
        n = draw.randrange(0, 9)
        turns = sorted([(draw.choice([None, t, t, 2 * t, 3]), draw.choice(["user", "assistant", "system", " ", "", "used", "Assistant"]), draw.choice(texts)) for t in range(n)], key=order)
        times = {t: draw.choice([1, 1, 1, 2]) for t in turns}
        rows += [(conv, *t, times[t]) for t in turns] + [(conv, 50, "user", "gone.", 0)]
        want[conv] = plain_repair([t for t in turns for _ in range(times[t])])
    table = spark.createDataFrame([(*r, *CLASH) for r in rows], "conv_id long, turn long, role string, text string, times int, signature string, n int, new int, kind int, at int").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in structure_repair.repair(table).collect()}
    assert got == want
    assert structure_repair.repair(table.limit(0)).count() == 0


def test_repair_after_damage(spark):
    """Nulls, one long conversation, one of many equal rows, and none left."""
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(None, None, None, None), (gone, 0, "user", "x")] + [(7, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(20_000)] + [(8, 3, "user", "same.")] * 5000 + [(9, 0, "user", "x" * 5_000_000)]
    table = spark.createDataFrame([(*r, *CLASH) for r in rows], TURNS)
    got = {r.conv_id: r for r in structure_repair.repair(structure_repair.damage(table)).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[8].duplicate >= 4999 and got[8].audit == "K" + "D" * got[8].duplicate + "I" and len(got[7].audit) > 18_000 and set(got) == {None, gone, 7, 8, 9}


DOCS = "doc_id long, text string, digest string, salt int, size int, shard int, block int, n int, rows int, bytes int, parts int, hot int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "d", *[1] * 9) for r in rows], DOCS)


def check_shards(got, rows, shards):
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    want = sorted(((i is not None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}


def test_shards_by_the_rule(spark):
    """Against the rule spelled out in plain Python, all pieces in one order."""
    draw = random.Random(3)
    rows = [(i, f"{i} " + " ".join(draw.choice(["a", "bb", "cccc"]) * draw.randrange(1, 9) for _ in range(draw.randrange(0, 60)))) for i in range(150)]
    got = sharding.shard_rows(docs_of(spark, rows), 5).collect()
    check_shards(got, rows, 5)
    total = [sum(len(t) + 16 for _, t in rows), sum(len(t.split()) for _, t in rows), len(rows)]
    vectors = {i: [x / y for x, y in zip((len(t) + 16, len(t.split()), 1), total, strict=True)] for i, t in rows}
    assert max(max(v) for v in vectors.values()) < 1 / 20  # none is large, so that one block holds all
    left, want = [[1 / 5] * 3 for _ in range(5)], {}
    for i, v in sorted(vectors.items(), key=lambda x: (-max(x[1]), hashlib.sha256(dict(rows)[x[0]].encode()).digest())):
        want[i] = max(range(5), key=lambda s: (round(sum(a * b for a, b in zip(left[s], v, strict=True)), 14), -s))
        left[want[i]] = [a - b for a, b in zip(left[want[i]], v, strict=True)]
    assert {r.doc_id: r.shard for r in got} == want


def test_shards_are_even(spark):
    """A text that a third of all rows share, null and repeated ids, a very long text, several blocks."""
    draw = random.Random(4)
    rows = [(None if i % 9 == 0 else i // 2, "hot text of many rows" if i % 3 == 0 else f"{i} " + "word " * draw.randrange(0, 30)) for i in range(60_000)] + [(7, None), (7, ""), (7, "")]
    got = sharding.shard_rows(docs_of(spark, rows).repartition(4)).collect()
    check_shards(got, rows, 40)
    sizes, counts, tokens = ([sum(f(r) for r in got if r.shard == s) for s in range(40)] for f in (lambda r: r.size, lambda _: 1, lambda r: r.tokens))
    for x in (sizes, counts, tokens):
        assert max(x) <= 1.02 * min(x)
    assert len({r.shard for r in got if r.size == 16}) == 1
    long = [*rows[:2000], (5, "x" * 20_000_000)]
    check_shards(sharding.shard_rows(docs_of(spark, long), 3).collect(), long, 3)
    assert sharding.shard_rows(docs_of(spark, [])).count() == 0
