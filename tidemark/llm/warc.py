"""WARC archives with an index merged from sorted runs.

Each record is a gzip member of its own, so that an index entry's place and length cut it out of the stored archive. Tasks
gather members into archives of bounded size, and Spark's text writer puts them on any file system, one row a file; a lost
task's archives are written again. Reading an archive gives a locally sorted run of captures; range partitioning by URL
key and time then gives each task slices of many runs, in Spark's shuffle files, which a loser tree merges.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, save, scratch

#: An equal payload of at least so many bytes is written once, and revisited by the others.
REVISIT_BYTES = 1000
#: An archive is closed at the record that brings it to so many bytes.
ARCHIVE_BYTES = 8 << 20
#: What the text writer ends a file with. A member's last byte is this one, or an empty member is put behind it.
LAST = b"\0"
#: Captures without a time count as taken at this second plus their page_id.
EPOCH = 1_577_836_800

RUN = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, captured string, url string, run string, at long, length long"


def url_key(url: Column) -> Column:
    """Host parts from the last to the first, then path and query, in lower case; scheme, www., port and fragment go."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\.)?|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r":\d+$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, r"^[^/?]*", ""))


def _header(value: Column) -> Column:
    """A value in one line of a header: control characters and % as %XX."""
    out = F.coalesce(value, F.lit(""))
    for c in ("%", "\r", "\n"):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _pack(archive_bytes: int):
    """Records (header, html, revisit) as gzip members, gathered into archives without their last byte, LAST."""

    def close(held: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(held)
        if not whole.endswith(LAST):  # the last record has 16 MB or more
            whole += _member(b"")
        return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], ["content"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for header, html, revisit in zip(*(batch.column(k) for k in range(3)), strict=True):
                body = b"" if revisit.as_py() else html.as_py().encode()
                held.append(_member(header.as_py().encode() + body + b"\r\n\r\n"))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return work


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A record for each row of (page_id, url, html): response, or revisit of the equal payload with the largest page_id.

    A null html is an empty payload; smaller payloads than revisit_bytes are all responses, and so are rows that repeat
    the largest page_id of their payload. A null page_id is less than all others and gives no date. Payloads are equal if
    their SHA-1, their length and a second hash agree. A very long page is one record. Other columns are ignored; an empty
    table writes no record.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("second", F.xxhash64("html"))
    key = ("digest", "n", "second")
    same = rows.where(F.col("n") >= revisit_bytes).groupBy(*[F.col(c).alias(f"of_{c}") for c in key]).agg(F.count("*").alias("c"), F.max("page_id").alias("refers_to")).where("c > 1").drop("c")
    same = save(same, "warc-equal")
    rows = rows.join(same, [F.col(c) == F.col(f"of_{c}") for c in key], "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    when = F.coalesce(F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z"))
    identity = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        # a number for rows that repeat a page_id: no two records share an id
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), identity, F.lit(":"), F.monotonically_increasing_id(), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _header(F.col("url"))),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("X-Payload-Bytes: "), F.col("n")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Url-Key: "), _header(url_key(F.col("url")))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n"))),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    archives = rows.select(header.alias("header"), F.when(revisit, "").otherwise(F.col("html")).alias("html"), revisit.alias("revisit")).mapInArrow(_pack(archive_bytes), "content binary")
    archives.select(F.col("content").cast("string").alias("value")).write.option("lineSep", LAST.decode()).option("maxRecordsPerFile", 1).text(path)
    discard(same)


def members(content: bytes | pa.Buffer) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member of a stored archive, one in memory at a time. Zeros after a member are filling."""
    view, at = memoryview(content), 0
    while at < len(view):
        if view[at] == 0:
            at += 1
            continue
        reader, out, place = zlib.decompressobj(31), [], at
        while not reader.eof:
            if place >= len(view):
                raise ValueError(f"the member at {at} doesn't end")
            piece = view[place : place + (1 << 16)]
            out.append(reader.decompress(piece))
            place += len(piece) - len(reader.unused_data)
        yield at, place - at, b"".join(out)
        at = place


def record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of a record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    header = dict(line.split(": ", 1) for line in lines)
    size = int(header.get("Content-Length", -1))
    if first != "WARC/1.1" or not found or rest[size:] != b"\r\n\r\n":
        raise ValueError("no whole record")
    return header, rest[:size]


def records(content: bytes | pa.Buffer) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, block) of each record of a stored archive."""
    for at, length, data in members(content):
        if data:
            yield at, length, *record(data)


def _plain(value: str) -> str:
    for c in ("\n", "\r", "%"):
        value = value.replace(f"%{ord(c):02X}", c)
    return value


def _page(value: str | None) -> int | None:
    return int(value) if value not in (None, "", "null") else None


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.strip().split()[0] for f in RUN.split(",")]
    kinds = [pa.string() if f.strip().split()[1] == "string" else pa.int64() for f in RUN.split(",")]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for at, length, h, block in records(content.as_buffer()):
                n, digest = int(h["X-Payload-Bytes"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                if h["WARC-Type"] == "response" and (len(block) != n or hashlib.sha1(block).hexdigest() != digest):
                    raise ValueError(f"{path}: the payload at {at} isn't what was written")
                rows.append((_page(h["WARC-Record-ID"].split(":")[2]), n, digest, h["WARC-Type"], _page(h.get("X-Refers-To-Page")), _plain(h["X-Url-Key"]), h["WARC-Date"], _plain(h["WARC-Target-URI"]), path, at, length))
            rows.sort(key=lambda r: (r[5], r[6], r[0] is not None, r[0]))
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], fields)


def merged(runs: list[list], key) -> Iterator:
    """All items of sorted runs in order, by a tree of losers: one comparison a level for each item."""
    k = len(runs)
    if not k:
        return
    top = (1,)  # after every (0, key)
    places = [0] * k
    head = [(0, key(r[0])) if r else top for r in runs]
    losers = [-1] * k
    winner = -1
    for i in range(k):  # play each run in from its leaf
        now, node = i, (i + k) // 2
        while node and losers[node] != -1:
            if (head[losers[node]], losers[node]) < (head[now], now):
                now, losers[node] = losers[node], now
            node //= 2
        if node:
            losers[node] = now
        else:
            winner = now
    while head[winner] != top:
        yield runs[winner][places[winner]]
        places[winner] += 1
        run = runs[winner]
        head[winner] = (0, key(run[places[winner]])) if places[winner] < len(run) else top
        node = (winner + k) // 2
        while node:
            if (head[losers[node]], losers[node]) < (head[winner], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted stream from a task's slices of runs. The slices are held as Arrow columns; of each run only the head's key is a Python value, and rows leave in batches."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    names = table.column("run").combine_chunks().dictionary_encode()
    names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
    run = names.indices.to_numpy()
    urlkey, captured, page = (table.column(c).chunk(0) for c in ("urlkey", "captured", "page_id"))
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    slices = [range(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(run)], strict=True)]
    order: list[int] = []
    for i in merged(slices, lambda i: (urlkey[i].as_py(), captured[i].as_py(), page[i].is_valid, page[i].as_py() or 0)):
        order.append(i)
        if len(order) == 10_000:
            yield from table.take(pa.array(order)).combine_chunks().to_batches()
            order = []
    if order:
        yield from table.take(pa.array(order)).combine_chunks().to_batches()


def read_index(spark, path: str, index_rows: int = 100_000) -> DataFrame:
    """All captures of the archives under path, globally ordered by URL key, time and page_id, about index_rows in a task.

    run, at and length say where a record is stored. Repeated captures of one URL and time are all there, in the order of
    page_id, null first. A folder without records gives an empty index.
    """
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    found = save(archives.mapInArrow(_read_runs, RUN), "warc-runs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // index_rows)
    dealt = found.repartitionByRange(parts, "urlkey", "captured", "page_id", "at").sortWithinPartitions("run", "urlkey", "captured", "page_id")
    return dealt.mapInArrow(_merge, RUN)


def capture_histories(pages: DataFrame) -> DataFrame:
    """Write pages as archives, read them back, and return the merged index. An empty table gives an empty index."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_index(pages.sparkSession, path)
