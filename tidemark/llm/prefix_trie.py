"""The prefix trie of conversations, from the Cartesian tree over the LCP array of their sorted order.

Each conversation is a key of sixteen bytes a turn. Range partitions sorted by key and id are cut into blocks; a block
finds the nearest smaller values of its LCP array with a stack, merges nodes of equal LCP, expands the depths that lie
between a node and its parent, and writes every node whose interval lies inside. What is left of a block are its prefix
and suffix minima, a few rows: one task runs the same sweep over those of all blocks and writes the nodes that cross blocks.
Sums over an interval are carried along as it grows, so no node's members are listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, runs, save

#: Bytes of a turn in a key, of its SHA-256.
WIDTH = 16
#: A block ends at so many conversations or turns, whichever comes first; it holds one conversation at least.
BLOCK_CONVS, BLOCK_TURNS = 20_000, 200_000
FLUSH = 20_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind 0: a node, with idx where its parent is settled by the event (block, idx); kind 1: an event; kind 2: what an event's parent is.
SWEPT = f"kind int, block long, idx int, {NODE}, first_joint long, turns long, chars binary, key binary, ends string"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_FIELDS = [(f.split()[0], _TYPES[f.split()[1]]) for f in SWEPT.split(", ")]
_NODES = [f.split()[0] for f in NODE.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """Sixteen bytes for each distinct (role, text)."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos from 1, digest, chars: turns by (turn, nulls first; digest). Texts don't move: the digest and the number of code points stand for them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("chars"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv_id", pos.cast("long").alias("pos"), "digest", "chars")


def grafted(turns: DataFrame, every: int, most: int) -> DataFrame:
    """conv_id, part, pos, digest, chars: conversation c begins with the first h turns of conversation c - c % every, h = crc32(c) % most, and goes on after its own first h. A row without a digest stands for each conversation, so that one without turns is there too."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.where(F.col("pos") > h).select("conv_id", F.lit(2).alias("part"), "pos", "digest", "chars")
    ids = turns.where("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    head = ids.where("h > 0").join(heads, "base").where("pos <= h").select("conv_id", F.lit(1).alias("part"), "pos", "digest", "chars")
    marks = ids.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return own.unionByName(head).unionByName(marks)


def plain(turns: DataFrame) -> DataFrame:
    """The same rows without any grafting."""
    return turns.select("conv_id", F.lit(1).alias("part"), "pos", "digest", "chars")


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "key", "chars"]
    out: list[tuple] = []
    conv, keys, chars, held = None, [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2))], names)

    for (key,), rows, first in runs(batches, ["conv_id"]):
        if first:
            if conv is not None:
                out.append((conv, b"".join(keys), b"".join(chars)))
                held += len(out[-1][1])
            conv, keys, chars = key, [], []
            if len(out) >= FLUSH or held > 1 << 23:
                yield batch()
                out, held = [], 0
        keys += [d for d in rows.column("digest").to_pylist() if d is not None]
        there = rows.filter(rows.column("digest").is_valid())
        chars.append(np.asarray(there.column("chars"), "<i8").tobytes())
    if conv is not None:
        out.append((conv, b"".join(keys), b"".join(chars)))
    if out:
        yield batch()


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, key, chars: one row for each conversation of (conv_id, part, pos, digest, chars)."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(_sequences, "conv_id long, key binary, chars binary")


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys share from the start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    while high - low > 1:  # low turns are equal, high turns aren't
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH] else (low, mid)
    return low


class _Part:
    """Neighbours in sorted order: how many, leaves among them, shared characters behind the first and at its left border, least id, children and ends they are to the node they join. turns is set for a single conversation."""

    __slots__ = ("border", "ends", "inner", "joint", "kids", "leaves", "low", "n", "turns")

    def __init__(self, n: int, leaves: int, inner: int, joint: int, low: int, kids: int = 1, ends: str = "", turns: int | None = None, border: int = -1) -> None:
        self.n, self.leaves, self.inner, self.joint, self.low, self.kids, self.ends, self.turns, self.border = n, leaves, inner, joint, low, kids, ends, turns, border

    def under(self, depth: int) -> tuple[int, str]:
        if self.turns is None:
            return self.kids, self.ends
        return (1, "") if self.turns > depth else (0, str(self.low))


class _Open:
    """A node whose right end isn't known: its depth, its first part (None: it began before the block) and the sum of the others."""

    __slots__ = ("depth", "first", "hash", "keep", "kids", "refs", "rest", "waiting", "written")

    def __init__(self, depth: int, first: _Part | None, keep_ends: bool) -> None:
        self.depth, self.first, self.rest, self.keep = depth, first, None, keep_ends
        self.kids, ends = first.under(depth) if first else (0, "")
        self.refs, self.waiting = [], []
        self.hash = hashlib.sha256(ends.encode()) if first else None
        self.written = bool(ends)

    def join(self, part: _Part) -> None:
        kids, ends = part.under(self.depth)
        self.kids += kids
        if self.rest is None:
            self.rest = _Part(0, 0, 0, 0, part.low, 0)
            self.rest.ends = []
        rest = self.rest
        rest.n, rest.leaves, rest.inner, rest.low = rest.n + part.n, rest.leaves + part.leaves, rest.inner + part.inner + part.joint, min(rest.low, part.low)
        rest.kids += kids
        if ends:
            if self.hash is not None:
                self.hash.update((("," if self.written else "") + ends).encode())
            if self.keep:
                rest.ends.append(ends)
            self.written = True


class _Sweep:
    """The stack over an LCP array. ends_kept: parts handed on need the ids that end in them, so they are kept beside the hash."""

    def __init__(self, ends_kept: bool) -> None:
        self.stack: list[_Open] = []
        self.nodes: list[tuple] = []
        self.left: list[tuple[int, _Part | None, _Open]] = []
        self.ends_kept = ends_kept
        self.settled: list[tuple[int, int, int]] = []

    def chain(self, part: _Part, above: int, parent: _Open) -> None:
        """The nodes that a single conversation has alone, below depth `above`."""
        ends = hashlib.sha256(str(part.low).encode()).hexdigest()
        for d in range(above + 1, part.turns + 1):
            last = d == part.turns
            self.put((part.low, d, part.low, 1, 0 if last else 1, 1, 0, ends if last else NO_ENDS), parent if d == above + 1 else None)

    def put(self, node: tuple, parent: _Open | None) -> None:
        if parent is None:
            self.nodes.append(node)
        elif parent.depth < 0:
            self.nodes.append((node[0], node[1], None, *node[3:]))
        else:
            parent.waiting.append(node)

    def close(self, node: _Open, above: int, parent: _Open, sums: np.ndarray) -> _Part:
        """Write an interval's nodes, from the depth below its parent's to its own; sums: characters of any member's first turns."""
        first, rest = node.first, node.rest
        n, leaves, inner, low = first.n, first.leaves, first.inner, first.low
        if rest:
            n, leaves, inner, low = n + rest.n, leaves + rest.leaves, inner + rest.inner, min(low, rest.low)
        for d in range(above + 1, node.depth + 1):
            deep = d == node.depth
            before = int(sums[d - 1]) if d > 0 else 0
            saved = inner - (n - 1) * before
            self.put((low, d, low, n, node.kids if deep else 1, leaves, saved, node.hash.hexdigest() if deep else NO_ENDS), parent if d == above + 1 else None)
        self.settle(node, low)
        return _Part(n, leaves, inner, first.joint, low)

    def settle(self, node: _Open, low: int) -> None:
        for d in node.waiting:
            self.nodes.append((d[0], d[1], low, *d[3:]))
        self.settled += [(block, idx, low) for block, idx in node.refs]
        node.waiting, node.refs = [], []

    def arrive(self, x: int, part: _Part | None, sums: np.ndarray, single: _Part | None) -> None:
        """An LCP value x behind `part` (None: what began before the block). single: the conversation itself, whose own nodes are written here."""
        stack, new = self.stack, _Open(x, None, self.ends_kept)
        if single is not None:
            single.leaves = int(x < single.turns)
            above = max(single.border, x)
            if single.turns > above:
                self.chain(single, above, stack[-1] if single.border >= x else new)
        while stack and stack[-1].depth > x:
            node = stack.pop()
            if part is not None:
                node.join(part)
            if not stack:  # it began before the block
                self.left.append((node.depth, node.rest, node))
                part = None
            else:
                part = self.close(node, max(x, stack[-1].depth), stack[-1] if stack[-1].depth >= x else new, sums)
        if stack and stack[-1].depth == x:
            if part is not None:
                stack[-1].join(part)
            if new.waiting:
                stack[-1].waiting += new.waiting
        else:
            made = _Open(x, part, self.ends_kept)
            made.waiting = new.waiting
            stack.append(made)


def _sums(chars: bytes) -> np.ndarray:
    """Characters of the first 0, 1, 2, ... turns."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(chars, "<i8"))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS], [n for n, _ in _FIELDS])


def _written(nodes: list[tuple], block: int | None = None, idx: int | None = None) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(nodes), FLUSH):
        piece = nodes[start : start + FLUSH]
        columns = dict(zip(_NODES, zip(*piece, strict=True), strict=True))
        columns |= {"kind": [0] * len(piece), "block": [block] * len(piece), "idx": [idx] * len(piece)}
        yield pa.RecordBatch.from_arrays([pa.array(columns.get(n, [None] * len(piece)), t) for n, t in _FIELDS], [n for n, _ in _FIELDS])


def _event(block: int, idx: int, x: int | None, p: _Part, key: bytes | None = None, chars: bytes | None = None) -> dict:
    ends = p.ends if isinstance(p.ends, str) else ",".join(p.ends)
    return {"kind": 1, "block": block, "idx": idx, "depth": x, "conv_id": p.low, "n_convs": p.n, "n_children": p.kids, "n_leaves": p.leaves, "saved_tokens": p.inner, "first_joint": p.joint, "turns": p.turns, "chars": chars, "key": key, "ends": ends}


def _block(block: int, convs: list[int], keys: list[bytes], chars: list[bytes]) -> Iterator[pa.RecordBatch]:
    sweep, n = _Sweep(True), len(convs)
    part = single = None
    sums = _sums(chars[0])
    for i in range(1, n):
        x = common_turns(keys[i - 1], keys[i])
        sweep.arrive(x, part, sums, single)
        if len(sweep.nodes) >= FLUSH:
            yield from _written(sweep.nodes)
            sweep.nodes = []
        sums = _sums(chars[i])
        part = single = _Part(1, 0, 0, int(sums[x]), convs[i], 0, "", len(keys[i]) // WIDTH, x)
    # what is left: the first conversation, prefix minima, suffix minima with the parts between, the last conversation
    first = _Part(1, 0, 0, 0, convs[0], 0, "", len(keys[0]) // WIDTH)
    events = [_event(block, 0, None, first, keys[0], chars[0])]
    owners: list[tuple[int, _Open]] = []
    for depth, rest, node in sweep.left:
        owners.append((len(events), node))
        events.append(_event(block, len(events), depth, rest))
    for i, node in enumerate(sweep.stack):
        if i:
            head = node.first
            kids, ends = head.under(node.depth)
            events.append(_event(block, len(events), sweep.stack[i - 1].depth, _Part(head.n, head.leaves, head.inner, head.joint, head.low, kids, ends)))
        owners.append((len(events), node))
        if node.rest:
            events.append(_event(block, len(events), node.depth, node.rest))
    if n > 1:
        events.append(_event(block, len(events), single.border, single, keys[-1], chars[-1]))
    yield from _written(sweep.nodes)
    for idx, node in owners:
        yield from _written(node.waiting, block, idx)
    for start in range(0, len(events), 64):
        yield _batch(events[start : start + 64])


def _blocks(batches: Iterator[pa.RecordBatch], most_convs: int, most_turns: int) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 32
    convs, keys, chars, turns = [], [], [], 0
    for batch in batches:
        for conv, key, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "chars")), strict=True):
            if convs and (len(convs) >= most_convs or turns >= most_turns):
                yield from _block(at, convs, keys, chars)
                at, convs, keys, chars, turns = at + 1, [], [], [], 0
            convs.append(conv)
            keys.append(key)
            chars.append(size)
            turns += len(key) // WIDTH
    if convs:
        yield from _block(at, convs, keys, chars)


def _spine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sweep over what all blocks left, in order."""
    sweep = _Sweep(False)
    sweep.stack.append(_Open(-1, None, False))
    part = single = key = None
    sums = np.zeros(1, "<i8")

    def flush() -> Iterator[pa.RecordBatch]:
        yield from _written(sweep.nodes)
        yield from (_batch([{"kind": 2, "block": b, "idx": i, "parent_conv_id": low} for b, i, low in sweep.settled[s : s + FLUSH]]) for s in range(0, len(sweep.settled), FLUSH))
        sweep.nodes, sweep.settled = [], []

    for batch in batches:
        for row in batch.to_pylist():
            x, begins = row["depth"], row["idx"] == 0
            if begins:
                x = -1 if key is None else common_turns(key, row["key"])
            if key is not None:
                sweep.arrive(x, part, sums, single)
                sweep.stack[-1].refs.append((row["block"], row["idx"]))
            part = _Part(row["n_convs"], row["n_leaves"], row["saved_tokens"], row["first_joint"], row["conv_id"], row["n_children"], row["ends"], row["turns"], x)
            single = part if part.turns is not None else None
            if single:
                key, sums = row["key"], _sums(row["chars"])
                part.joint = int(sums[x]) if x > 0 else 0
        if len(sweep.nodes) + len(sweep.settled) >= FLUSH:
            yield from flush()
    if key is not None:
        sweep.arrive(-1, part, sums, single)
    yield from flush()


def trie_nodes(sequences: DataFrame, block_convs: int = BLOCK_CONVS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row for each node of the trie of a written table (conv_id, key, chars), key of sixteen bytes a turn: the columns of NODE.

    conv_id is the least member and parent_conv_id the parent's (null for the root); saved_tokens sums the characters that
    the subtree's nodes save. An empty table has no node. A key and a conversation's ends in a block are each one value.
    """
    swept = save(sequences.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(lambda rows: _blocks(rows, block_convs, block_turns), SWEPT), "trie-blocks")
    events = swept.where("kind = 1").repartition(1).sortWithinPartitions("block", "idx")
    spine = save(events.mapInArrow(_spine, SWEPT), "trie-spine")
    links = spine.where("kind = 2").select("block", "idx", F.col("parent_conv_id").alias("above"))
    inside = swept.where("kind = 0")
    below = inside.where("idx IS NOT NULL").drop("parent_conv_id").join(links, ["block", "idx"]).withColumnRenamed("above", "parent_conv_id")
    return inside.where("idx IS NULL").select(_NODES).unionByName(below.select(_NODES)).unionByName(spine.where("kind = 0").select(_NODES))


def conversation_trie(conversations: DataFrame, graft_every: int | None = None, graft_most: int = 6, block_convs: int = BLOCK_CONVS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie of all conversations: the columns of NODE, one row for each distinct sequence of first turns.

    Turns go by turn, nulls first, and by digest where they share one; a null role or text counts as empty; rows without
    a conv_id belong to no conversation and are left out; rows that repeat are turns that repeat. Other columns are
    ignored; an empty table has no node, not even the root. With graft_every, conversation c begins with turns of
    conversation c - c % graft_every (`grafted`); if that leaves it no turn it is a member of the root alone. A turn
    takes 16 bytes of its conversation's key, which is one value; no text moves.
    """
    turns = save(numbered_turns(conversations), "turns")
    built = save(sequences(grafted(turns, graft_every, graft_most) if graft_every else plain(turns)), "sequences")
    discard(turns)
    nodes = trie_nodes(built, block_convs, block_turns)
    discard(built)
    return nodes


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string."""
    step = "lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ord(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {step})), 4294967295)"


ORACLE = f"""
WITH named AS (
  SELECT conv_id, turn, len(coalesce(text, '')) AS chars, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, chars, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(t, 1, 32)) AS pos FROM named
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM named)
), rebuilt AS (
  SELECT i.conv_id, o.chars, o.t, 0 AS part, o.pos FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos <= i.h
  UNION ALL SELECT i.conv_id, o.chars, o.t, 1, o.pos FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM rebuilt
), paths AS (
  SELECT conv_id, depth, chars, sha256(string_agg(t, ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS node FROM placed
), members AS (
  SELECT conv_id, 0 AS depth, 0 AS chars, '' AS node, NULL AS above FROM ids
  UNION ALL SELECT conv_id, depth, chars, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') FROM paths
), lengths AS (
  SELECT conv_id, max(depth) AS n FROM members GROUP BY conv_id
), nodes AS (
  SELECT node, min(depth) AS depth, min(above) AS above, min(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = n) AS ends
  FROM members JOIN lengths USING (conv_id) GROUP BY node
), children AS (
  SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above
), below AS (
  SELECT m.node, sum((d.n_convs - 1) * d.chars) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM nodes d LEFT JOIN children c ON d.node = c.node JOIN members m ON m.conv_id = d.conv_id AND m.depth <= d.depth GROUP BY m.node
)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM nodes x JOIN below b ON x.node = b.node LEFT JOIN children c ON x.node = c.node LEFT JOIN nodes p ON x.above = p.node
"""
