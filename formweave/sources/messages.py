"""Framed messages as a data source: files of little-endian lengths and payloads, read and written in batches and streams.

    spark.dataSource.register(FramedSource)
    df.write.format("framed").save(folder)            # df has a binary column `payload`
    spark.read.format("framed").load(folder)           # (file, pos, payload)
    spark.readStream.format("framed").load(folder)     # files that appear, each once

A file is a partition and is read message by message, so a task holds one of at most MOST_MESSAGE bytes. A clean end of a
file is no error; one within a length or a message, or a longer length, raises ValueError. The folder is a path that driver
and executors mount alike; files in stores that only Spark reads come through `framed_messages` and binaryFile.
A writing task makes a file of its own under a hidden name, and the commit renames the files of the tasks that won, so a
lost or repeated task leaves nothing that is read.
"""

from __future__ import annotations

import os
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from formweave.sources.office import MOST_MESSAGE, frame, frames

SUFFIX = ".frames"


def _local(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


def read_frames(file: str) -> Iterator[bytes]:
    with open(file, "rb") as f:
        while head := f.read(4):
            if len(head) < 4:
                raise ValueError(f"{file} ends within a length")
            (n,) = struct.unpack("<I", head)
            if n > MOST_MESSAGE:
                raise ValueError(f"{file} has a message of {n} bytes")
            body = f.read(n)
            if len(body) < n:
                raise ValueError(f"{file} ends within a message")
            yield body


def _files(folder: str) -> list[str]:
    return sorted(n for n in os.listdir(folder) if n.endswith(SUFFIX) and not n.startswith(("_", ".")))


@dataclass
class FilePartition(InputPartition):
    folder: str
    name: str


class FramedReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(self.folder, n) for n in _files(self.folder)]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        if partition is not None:
            for k, payload in enumerate(read_frames(os.path.join(partition.folder, partition.name))):
                yield partition.name, k, payload


class FramedStreamReader(DataSourceStreamReader):
    """Files in the order of their names, which must grow with time, as those of the writer do; the offset is the last name.
    The driver lists names only; tasks read."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = _files(self.folder)
        return {"after": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        return [FilePartition(self.folder, n) for n in _files(self.folder) if start["after"] < n <= end["after"]]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return ((partition.name, k, payload) for k, payload in enumerate(read_frames(os.path.join(partition.folder, partition.name))))

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    name: str


class FramedWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.run = folder, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        os.makedirs(folder, exist_ok=True)

    def write(self, rows: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        name = f"{self.run}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{SUFFIX}"
        with open(os.path.join(self.folder, f"_{name}"), "wb") as f:
            for r in rows:
                f.write(frame(bytes(r.payload)))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        for m in sorted(filter(None, messages), key=lambda m: m.name):
            os.rename(os.path.join(self.folder, f"_{m.name}"), os.path.join(self.folder, m.name))

    def abort(self, messages: list[Written | None]) -> None:
        for n in os.listdir(self.folder):
            if n.startswith(f"_{self.run}"):
                os.remove(os.path.join(self.folder, n))


class FramedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return "file string, pos long, payload binary"

    def _folder(self) -> str:
        if not (path := self.options.get("path")):
            raise ValueError("a path is needed")
        return _local(path)

    def reader(self, schema: StructType) -> FramedReader:
        return FramedReader(self._folder())

    def streamReader(self, schema: StructType) -> FramedStreamReader:
        return FramedStreamReader(self._folder())

    def writer(self, schema: StructType, overwrite: bool) -> FramedWriter:
        if overwrite:
            raise ValueError("framed files are appended to a folder, not overwritten")
        return FramedWriter(self._folder())


def framed_messages(files: DataFrame, doc: str = "path", content: str = "content") -> DataFrame:
    """(doc, pos, payload) of files as the binaryFile source gives them, from any store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, raw in zip(b.column("doc").to_pylist(), b.column("content"), strict=True):
                found = frames(raw.as_py() or b"")
                yield pa.record_batch([pa.array([k] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.binary())], ["doc", "pos", "payload"])

    return files.select(F.col(doc).cast("string").alias("doc"), F.col(content).alias("content")).mapInArrow(run, "doc string, pos long, payload binary")
