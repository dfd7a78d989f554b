"""Sinks that add files to a folder, CSV or JSON lines, each transaction once."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    """The file that a task has written under a hidden name; None if it had no rows."""

    file: str | None
    rows: int


class _Lines:
    def __init__(self, out, schema: pa.Schema) -> None:
        self.out = out

    def write(self, batch: pa.RecordBatch) -> None:
        self.out.write("".join(json.dumps(r, default=str, ensure_ascii=False) + "\n" for r in batch.to_pylist()).encode())

    def close(self) -> None:
        pass


FORMATS = {"csv": csv.CSVWriter, "json": _Lines}


class Folder:
    """Where files are staged by tasks and added by the driver, on any file system that Arrow knows (local, HDFS, object stores).

    A task writes a hidden file of its own, which readers don't see, batch by batch. The commit of a transaction gives the files
    of the attempts that won visible names, then leaves a marker. A transaction whose marker is there adds nothing more; one
    that was cut off within its commit is begun anew, so that its rows are there once. Files of lost tasks stay hidden.
    """

    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = re.sub(r"^file:/+", "/", path.rstrip("/")), kind

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path, recursive=True)
        return system, path

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        system, path = self._open()
        file, writer, out, rows = f"{path}/.staged-{uuid.uuid4().hex}.{self.kind}", None, None, 0
        try:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                if writer is None:
                    out = system.open_output_stream(file)
                    writer = FORMATS[self.kind](out, batch.schema)
                writer.write(batch)
                rows += batch.num_rows
            if writer is not None:
                writer.close()
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(file)
            raise
        return Staged(file if rows else None, rows)

    def commit(self, staged: Sequence[Staged | None], transaction: str) -> None:
        system, path = self._open()
        marker, prefix = f"{path}/_committed-{transaction}", f"part-{transaction}-"
        if system.get_file_info(marker).type != fs.FileType.NotFound:
            self.abort(staged)
            return
        for old in system.get_file_info(fs.FileSelector(path)):
            if old.base_name.startswith(prefix):
                system.delete_file(old.path)
        for i, one in enumerate(s for s in staged if s and s.file):
            system.move(one.file, f"{path}/{prefix}{i}.{self.kind}")
        system.open_output_stream(marker).close()

    def abort(self, staged: Sequence[Staged | None]) -> None:
        system, _ = self._open()
        for one in staged:
            if one and one.file and system.get_file_info(one.file).type != fs.FileType.NotFound:
                system.delete_file(one.file)


class _Batch(DataSourceArrowWriter):
    def __init__(self, folder: Folder, transaction: str) -> None:
        self.folder, self.transaction = folder, transaction

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.folder.stage(iterator)

    def commit(self, messages: list[Staged | None]) -> None:
        self.folder.commit(messages, self.transaction)

    def abort(self, messages: list[Staged | None]) -> None:
        self.folder.abort(messages)


class _Stream(DataSourceStreamArrowWriter):
    def __init__(self, folder: Folder, transaction: str) -> None:
        self.folder, self.transaction = folder, transaction

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.folder.stage(iterator)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.folder.commit(messages, f"{self.transaction}.{batchId}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self.folder.abort(messages)


class _Sink(DataSource):
    kind = ""

    def _target(self) -> tuple[Folder, str]:
        transaction = self.options.get("transaction") or uuid.uuid4().hex
        if not re.fullmatch(r"\w+", transaction):
            raise ValueError(f"transaction {transaction!r} may hold letters, digits and _ only")
        return Folder(self.options["path"], self.kind), transaction

    def writer(self, schema, overwrite: bool) -> _Batch:
        if overwrite:
            raise ValueError("this sink only appends")
        return _Batch(*self._target())

    def streamWriter(self, schema, overwrite: bool) -> _Stream:  # noqa: N802
        if not self.options.get("transaction"):
            raise ValueError("a stream needs a transaction name that stays the same when it is started again")
        return _Stream(*self._target())


class AppendCsv(_Sink):
    """`df.write.format("append_csv").mode("append").option("transaction", name).save(path)`; a header in each file."""

    kind = "csv"

    @classmethod
    def name(cls) -> str:
        return "append_csv"


class AppendLines(_Sink):
    """`append_lines`, an object a line; as a stream's sink each micro-batch is a transaction."""

    kind = "json"

    @classmethod
    def name(cls) -> str:
        return "append_lines"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AppendCsv)
    spark.dataSource.register(AppendLines)
