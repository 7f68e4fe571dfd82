"""Framed binary message streams: files of a 16-bit length and a body, repeated.

``spark.read.format("framed")`` reads files that the executors can open, one task a
file, in a bounded buffer (plain or gzip).  ``split_frames`` does the same for the
contents that Spark's own ``binaryFile`` reads from any store.  A cut stream is an
error, never a shorter result.  ``idx`` numbers the messages of a file from 0;
``in_order`` numbers them over all files of a folder.
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import codec
from ..plans import scratch

SCHEMA = "file string, idx long, len int, body binary"
_ARROW = pa.schema([("file", pa.string()), ("idx", pa.int64()), ("len", pa.int32()), ("body", pa.binary())])
BUFFER, BATCH = 1 << 20, 1 << 16
LONGEST = 65_535


def frames(read, name: str) -> Iterator[bytes]:
    """The bodies of a stream; ``read(n)`` gives up to n bytes, none at the end."""
    held, at = b"", 0
    while True:
        while len(held) - at < 2 or len(held) - at - 2 < int.from_bytes(held[at : at + 2], "big"):
            more = read(BUFFER)
            if not more:
                if len(held) - at == 0:
                    return
                raise ValueError(f"{name} ends inside a {'length prefix' if len(held) - at < 2 else 'message'}")
            held, at = held[at:] + more, 0
        size = int.from_bytes(held[at : at + 2], "big")
        yield held[at + 2 : at + 2 + size]
        at += 2 + size


def _opened(path: str, compression: str):
    if compression not in ("auto", "none", "gzip"):
        raise ValueError(f"compression is auto, none or gzip, not {compression}")
    zipped = compression == "gzip" or compression == "auto" and path.endswith(".gz")
    return gzip.open(path, "rb") if zipped else open(path, "rb")


@dataclass
class _File(InputPartition):
    path: str


def _local(path: str) -> str:
    """A path that executors can open; other stores are read by ``split_frames``."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"{path} is in a store that only Spark reads: give its binaryFile contents to split_frames")
    return "/" + rest.lstrip("/")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.compression = _local(options["path"]), options.get("compression", "auto")

    def partitions(self) -> list[_File]:
        found = sorted(glob.glob(os.path.join(self.path, "[!_.]*"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path, self.compression) as file:
            bodies: list[bytes] = []
            first = 0
            for body in frames(file.read, partition.path):
                bodies.append(body)
                if len(bodies) == BATCH:
                    yield self._batch(partition.path, first, bodies)
                    first, bodies = first + len(bodies), []
            if bodies:
                yield self._batch(partition.path, first, bodies)

    @staticmethod
    def _batch(path: str, first: int, bodies: list[bytes]) -> pa.RecordBatch:
        n = len(bodies)
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), pa.array([len(b) for b in bodies], pa.int32()), pa.array(bodies, pa.binary())],
            schema=_ARROW,
        )


@dataclass
class _Written(WriterCommitMessage):
    path: str
    messages: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.zipped = _local(options["path"]), options.get("compression", "none") == "gzip"

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        part = TaskContext.get().partitionId()
        target = os.path.join(self.path, f"part-{part:06d}.frames" + (".gz" if self.zipped else ""))
        # written aside and renamed: a task that runs twice leaves one whole file
        aside = os.path.join(self.path, f"_{os.path.basename(target)}-{TaskContext.get().taskAttemptId()}")
        n = 0
        with gzip.open(aside, "wb") if self.zipped else open(aside, "wb") as file:
            for row in rows:
                body = bytes(row["body"])
                if len(body) > LONGEST:
                    raise ValueError(f"a message of {len(body)} bytes does not fit a frame")
                file.write(len(body).to_bytes(2, "big") + body)
                n += 1
        os.replace(aside, target)
        return _Written(target, n)


class FramedSource(DataSource):
    """``format("framed")``: options ``path`` (file, folder or pattern) and
    ``compression`` (auto, none, gzip; to write: none, gzip)."""

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramedSource)


def write_framed(bodies: DataFrame, path: str, compression: str = "none") -> None:
    """``idx, body`` as framed files, range-partitioned: file names follow the order."""
    register(bodies.sparkSession)
    ordered = bodies.select("idx", "body").repartitionByRange("idx").sortWithinPartitions("idx")
    ordered.select(F.lit("").alias("file"), "idx", F.length("body").alias("len"), "body").write.format("framed").option("path", path).option(
        "compression", compression
    ).mode("append").save()


def read_framed(spark: SparkSession, path: str, compression: str = "auto") -> DataFrame:
    """``format("framed")`` over ``path``."""
    register(spark)
    return spark.read.format("framed").option("path", path).option("compression", compression).load()


def split_frames(contents: DataFrame) -> DataFrame:
    """Messages of whole streams in ``path, content`` (as ``binaryFile`` gives them;
    gzip by its magic bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                raw = io.BytesIO(content)
                source = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
                rows = [(path, i, len(b), b) for i, b in enumerate(frames(source.read, path))]
                yield pd.DataFrame(rows, columns=["file", "idx", "len", "body"])

    return contents.select("path", "content").mapInPandas(run, SCHEMA)


def in_order(messages: DataFrame) -> DataFrame:
    """``idx`` over all files in the order of their names."""
    sizes = messages.groupBy("file").agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    bases = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return messages.join(scratch.small_side(bases), "file").withColumn("idx", F.col("idx") + F.col("base")).drop("base")


def decode(messages: DataFrame) -> DataFrame:
    """``file, idx, len, status`` and every field of the decoded types."""
    kind = codec.type_of(F.col("body"))
    return messages.select("file", "idx", "len", codec.status_of(kind, F.col("len")).alias("status"), *codec.decoded(F.col("body")).values())


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, sha256`` of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
