"""Repair the turn structure of conversations by a dynamic program shared over a prefix trie.

A conversation is a signature of one letter a row: role initial and fault. Sorted signatures are inserted into a trie,
range partition by range partition: what two neighbours share is the path that stays, and a layer of the program (the
cheapest edits up to here for each grammar state) is computed once for each node behind it. Where a signature ends, its
edits are read back along the path. A hot signature is dealt out by id, and costs each task one path.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.prefix_trie import crc32_sql
from tidemark.llm.shared import discard, runs, save

VISIBLE, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Costs of the edits, and of keeping a truncated row.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. Ends: nothing, or after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
#: State after an initial that may follow; by the same table what Insert and Rerole put.
FOLLOWS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
NEXT = {START: "u", AFTER_S: "u", AFTER_A: "u", AFTER_U: "a"}
CLOSING = {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}
FULL = {"u": "user", "a": "assistant"}
#: A letter is a role initial, in upper case if the row is truncated; x and X are all other initials, d is a row that must go.
SIGNED = "conv_id long, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"
PLANNED = SIGNED + ", cost long, audit string"
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TYPES = {"long": pa.int64(), "string": pa.string()}


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: each row as often as damage leaves it, 0 for a row that it drops. Drawn by the CRC-32 of `conv_id:turn`; nulls are one space."""
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    draw = F.crc32(said.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("times"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _schema(ddl: str) -> list[tuple[str, pa.DataType]]:
    return [(f.split()[0], _TYPES[f.split()[1]]) for f in ddl.split(", ")]


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    state: dict = {}
    held = 0

    def close() -> None:
        nonlocal held
        if state:
            gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
            out.append((state["conv"], "".join(state["letters"]), gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"]))
            held += len(out[-1][1])

    for (conv,), rows, first in runs(batches, ["conv_id"]):
        if first:
            close()
            state = {"conv": conv, "letters": [], "turns": 0, "low": 0, "high": 0, "last": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "before": None}
            if len(out) >= 10_000 or held > 1 << 23:
                yield _batch(out, SIGNED)
                out.clear()
                held = 0
        for turn, initial, n, blank, cut, new in zip(*(rows.column(c).to_pylist() for c in ("turn", "initial", "n", "blank", "cut", "new")), strict=True):
            if not n:
                continue
            if turn is not None and turn != state["last"]:
                state["low"] = min(state["low"], turn) if state["turns"] else turn
                state["high"], state["last"], state["turns"] = turn, turn, state["turns"] + 1
            doubles = 0 if blank else n - new
            fresh = n - doubles if not blank else 0
            state["blank"] += n if blank else 0
            state["duplicate"] += doubles
            state["truncated"] += fresh if cut else 0
            kind = initial if initial in ("s", "u", "a") else "x"
            state["letters"].append((kind.upper() if cut else kind) * fresh + "d" * (n - fresh))
            if state["before"] is not None:
                state["illegal"] += state["before"] + initial not in ("su", "ua", "au")
            state["illegal"] += (n - 1) * (initial + initial not in ("su", "ua", "au"))
            state["before"] = initial
    close()
    if out:
        yield _batch(out, SIGNED)


def signatures(damaged: DataFrame) -> DataFrame:
    """SIGNED: one row for each conversation of (conv_id, turn, role, text, times), rows by turn (nulls first), role and text's digest.

    Equal rows are counted before they move, and texts don't move at all: a row is its digest. A row is new where no row
    before it has its role and text, found by the least turn of each.
    """
    seen = F.regexp_like("text", F.lit(VISIBLE))
    cut = ~F.regexp_like("text", F.lit(ENDED))
    rows = damaged.select("conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), _digest().alias("digest"), (~seen).alias("blank"), (seen & cut).alias("cut"), "times")
    counted = save(rows.groupBy("conv_id", "turn", "role", "initial", "digest", "blank", "cut").agg(F.sum("times").cast("long").alias("n")), "turns-counted")
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    least = counted.where("n > 0").groupBy("conv_id", "digest").agg(F.min(at).alias("least"))
    met = counted.alias("c").join(least.alias("l").hint("merge"), F.col("c.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("c.digest") == F.col("l.digest")), "left")
    new = F.coalesce((at == F.col("least")).cast("long"), F.lit(0))
    ready = met.select("c.conv_id", "turn", "role", "initial", "c.digest", "n", "blank", "cut", new.alias("new"))
    return ready.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest").mapInArrow(_sign, SIGNED)


@functools.lru_cache(maxsize=1 << 16)
def layer(before: tuple, letter: str) -> tuple:
    """The layer behind a row: for each state None or (cost over the layer's least, rank of its edits by ASCII order, state before, edits); and what the least cost grew by.

    Edits of one layer differ before either ends (all end in the edit of the same row), so ranks order what follows them too. An
    Insert comes right before a Keep or Rerole: before a Delete it could as well come after, which is ASCII-less.
    """
    found: dict[int, tuple] = {}

    def put(state: int, cost: int, rank: int, at: int, edits: str) -> None:
        if state not in found or (cost, rank, edits) < found[state]:
            found[state] = (cost, rank, edits, at)

    for at in STATES:
        if before[at] is None:
            continue
        cost, rank = before[at][:2]
        put(at, cost + DELETE, rank, at, "D")
        if letter == "d":
            continue
        extra = TRUNCATED if letter.isupper() else 0
        for inserts in (0, 1):
            here = FOLLOWS[at, NEXT[at]] if inserts else at
            paid, edits = cost + inserts * INSERT + extra, "I" * inserts
            if (here, letter.lower()) in FOLLOWS:
                put(FOLLOWS[here, letter.lower()], paid + KEEP, rank, at, edits + "K")
            put(FOLLOWS[here, NEXT[here]], paid + REROLE, rank, at, edits + "R")
    least = min(x[0] for x in found.values())
    order = sorted(found, key=lambda s: found[s][1:3])
    return tuple((found[s][0] - least, order.index(s), found[s][3], found[s][2]) if s in found else None for s in STATES), least


FIRST = ((0, 0, None, ""), None, None, None)


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = [FIRST]  # a layer for each node from the root to here
    paid = [0]
    last, answer = "", (0, "")
    names = [n for n, _ in _schema(SIGNED)]
    for batch in batches:
        rows = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
        out, held = [], 0
        for row in rows:
            signature = row[1]
            if signature != last:
                shared = next((i for i, (a, b) in enumerate(zip(last, signature, strict=False)) if a != b), min(len(last), len(signature)))
                del path[shared + 1 :], paid[shared + 1 :]
                for letter in signature[shared:]:
                    new, least = layer(path[-1], letter)
                    path.append(new)
                    paid.append(paid[-1] + least)
                last, answer = signature, _answer(path, paid[-1])
            out.append((*row, *answer))
            held += len(signature) * 3
            if held > 1 << 23:
                yield _batch(out, PLANNED)
                out, held = [], 0
        if out:
            yield _batch(out, PLANNED)


def _answer(path: list[tuple], paid: int) -> tuple[int, str]:
    top = path[-1]
    state = min((s for s in STATES if top[s]), key=lambda s: (top[s][0] + INSERT * len(CLOSING[s]), top[s][1]))
    edits = [CLOSING[state]]
    cost = paid + top[state][0] + INSERT * len(CLOSING[state])
    for now in reversed(path[1:]):
        edits.append(now[state][3])
        state = now[state][2]
    return cost, "".join(reversed(edits))


def plans(signed: DataFrame) -> DataFrame:
    """PLANNED: the cheapest edits of each row of a written table of signatures."""
    return signed.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature", "conv_id").mapInArrow(_plan, PLANNED)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0
    plan, edits, hashed, begun, state, at = None, "", hashlib.sha256(), False, START, 0

    def put(role: str, text: str) -> None:
        nonlocal begun
        hashed.update(("\n" * begun + f"{role}:{text}").encode())
        begun = True

    def insert() -> None:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            put(FULL[NEXT[state]], "")
            state, at = FOLLOWS[state, NEXT[state]], at + 1

    def close() -> None:
        nonlocal held
        if plan is not None:
            insert()
            if at != len(edits):
                raise ValueError(f"conversation {plan[0]}: {len(edits) - at} edits are left")
            out.append((*plan, hashed.hexdigest()))
            held += len(edits)

    names = [n for n, _ in _schema(REPAIRED)][:-1]
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in (*names, "kind", "role", "text", "times")}
        for i in range(batch.num_rows):
            if columns["kind"][i] == 0:
                close()
                plan = tuple(columns[n][i] for n in names)
                edits, hashed, begun, state, at = plan[-1], hashlib.sha256(), False, START, 0
                if len(out) >= 10_000 or held > 1 << 23:
                    yield _batch(out, REPAIRED)
                    out.clear()
                    held = 0
                continue
            role, text = columns["role"][i], columns["text"][i]
            for _ in range(columns["times"][i]):
                insert()
                edit = edits[at]
                if edit == "K":
                    put(role, text)
                    state = FOLLOWS[state, role[:1]]
                elif edit == "R":
                    put(FULL[NEXT[state]], text)
                    state = FOLLOWS[state, NEXT[state]]
                at += 1
    close()
    if out:
        yield _batch(out, REPAIRED)


def repaired(damaged: DataFrame, planned: DataFrame) -> DataFrame:
    """REPAIRED: the plan of each conversation and the hash of what it makes of its rows, which stream past it by turn. Texts move here, once."""
    names = [n for n, _ in _schema(REPAIRED)][:-1]
    none = F.lit(None)
    plan = planned.select(*names, F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("binary").alias("digest"), F.lit(0).alias("times"))
    numbers = [none.cast("string" if n == "audit" else "long").alias(n) for n in names if n != "conv_id"]
    rows = damaged.where("times > 0").select("conv_id", *numbers, F.lit(1).alias("kind"), "turn", "role", "text", _digest().alias("digest"), "times")
    return plan.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest").mapInArrow(_repair, REPAIRED)


def repair(damaged: DataFrame) -> DataFrame:
    """REPAIRED for each conv_id of (conv_id, turn, role, text, times), texts and roles not null, also where no row is left (zeros, no edits).

    Rows go by turn, nulls first, and by role and digest where they share one. A null conv_id is a conversation of its
    own. A role counts by its first character. Of a conversation the signature and the edits, a letter or two a row, are one value, as
    the audit column asks; its texts stream through a task. An empty table gives an empty result; other columns are ignored.
    """
    signed = save(signatures(damaged), "signatures")
    planned = save(plans(signed), "plans")
    discard(signed)
    return repaired(damaged, planned)


ORACLE = rf"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, d FROM drawn
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || text)) AS i
  FROM (SELECT * FROM damaged WHERE d <> 0 UNION ALL SELECT * FROM damaged WHERE d = 3)
), judged AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '{VISIBLE}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '{ENDED}') THEN 'truncated' ELSE '' END AS fault FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
), follows(src, letter, state, name) AS (
  VALUES (0, 's', 1, 'system'), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (3, 'u', 2, 'user'), (2, 'a', 3, 'assistant')
), inserts AS (
  SELECT src, src AS here, 0 AS cost, '' AS edits, CAST([] AS VARCHAR[]) AS made FROM (VALUES (0), (1), (2), (3)) v(src)
  UNION ALL SELECT src, state, 2, 'I', [name || ':'] FROM follows WHERE letter <> 's'
), moves AS (
  SELECT i.src, f.state, i.cost, i.edits || 'K' AS edits, i.made, f.letter, NULL AS name FROM inserts i JOIN follows f ON f.src = i.here
  UNION ALL SELECT i.src, f.state, i.cost + 2, i.edits || 'R', i.made, NULL, f.name FROM inserts i JOIN follows f ON f.src = i.here AND f.letter <> 's'
  UNION ALL SELECT src, here, cost + 3, edits || 'D', made, NULL, NULL FROM inserts
), best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {{'cost': 0, 'edits': '', 'made': CAST([] AS VARCHAR[])}} AS b FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, state, min(c) FROM (
    SELECT o.conv_id, r.i, m.state, {{'cost': o.b.cost + m.cost + CASE WHEN fault = 'truncated' AND m.edits NOT LIKE '%D' THEN 1 ELSE 0 END, 'edits': o.b.edits || m.edits,
      'made': list_concat(o.b.made, m.made, CASE WHEN m.edits LIKE '%D' THEN [] ELSE [coalesce(m.name, r.role) || ':' || r.text] END)}} AS c
    FROM best o JOIN judged r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.i = o.i + 1 JOIN moves m ON m.src = o.state
    WHERE m.edits LIKE '%D' OR (fault NOT IN ('blank', 'duplicate') AND coalesce(m.letter = r.initial, true))
  ) GROUP BY conv_id, i, state
), ended AS (
  SELECT conv_id, i, {{'cost': b.cost + e.cost, 'edits': b.edits || e.edits, 'made': list_concat(b.made, e.made)}} AS b
  FROM best JOIN (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 4, 'II', ['user:', 'assistant:']), (2, 2, 'I', ['assistant:']), (3, 0, '', [])) e(state, cost, edits, made) USING (state)
), answers AS (
  SELECT e.conv_id, min(b) AS b FROM ended e LEFT JOIN (SELECT conv_id, max(i) AS n FROM judged GROUP BY conv_id) l ON e.conv_id IS NOT DISTINCT FROM l.conv_id
  WHERE e.i = coalesce(l.n, 0) GROUP BY e.conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(b.cost AS BIGINT) AS cost, b.edits AS audit, sha256(array_to_string(b.made, chr(10))) AS repaired_sha256
FROM answers a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
"""
