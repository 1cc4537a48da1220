"""Single files written by many tasks: tasks write parts to the session's shared folder, the driver's JVM joins them.

No row passes through the driver: it copies the bytes of one part after the other from file system to file system, and
puts the file in its place when it is whole.
"""

from __future__ import annotations

import contextlib
import os
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from millrace.plans.session import shared_folder
from millrace.sources.blockfile import file_system

#: Bytes that are copied at a time.
COPIED = 1 << 20


def staging(spark: SparkSession) -> str:
    """A new folder for parts, in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/single-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    """The Hadoop path and its file system; a plain path is one of this machine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else f"file:{os.path.abspath(path)}")
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def join_parts(spark: SparkSession, path: str, parts: Iterable[bytes | str], skip: int = 0) -> None:
    """Writes ``path`` from bytes and files in turn, without the first ``skip`` bytes of the first file that is not empty."""
    target, store = _place(spark, path)
    raw = store.getRaw() if target.toUri().getScheme() == "file" else store  # no checksum files beside local ones
    growing = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = raw.create(growing, True)
    try:
        for part in parts:
            if isinstance(part, bytes):
                out.write(part)
                continue
            at, held = _place(spark, part)
            if held.getFileStatus(at).getLen() == 0:
                continue
            source = held.open(at)
            try:
                source.seek(skip)
                skip = 0
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, COPIED, False)
            finally:
                source.close()
    except BaseException:
        out.close()
        raw.delete(growing, False)
        raise
    out.close()
    store.delete(target, False)
    if not raw.rename(growing, target):
        raise OSError(f"{path} could not be put in its place")


def removed_folder(spark: SparkSession, folder: str) -> None:
    at, store = _place(spark, folder)
    store.delete(at, True)


def write_lines(lines: DataFrame, path: str, end: str = "\n", before: Sequence[str] = (), after: Sequence[str] = (), skip: int = 0) -> None:
    """One file of the texts in ``lines``, its only column, in the order of its partitions; a null is an empty line."""
    spark, folder = lines.sparkSession, staging(lines.sparkSession)
    lines.write.option("lineSep", end).option("compression", "none").text(folder)
    try:
        at, store = _place(spark, folder)
        found = [s.getPath() for s in store.listStatus(at)]
        numbered = sorted((int(m[1]), p.getName(), p.toString()) for p in found if (m := re.match(r"part-(\d+)-", p.getName())))
        text = lambda part: "".join(line + end for line in part).encode()
        join_parts(spark, path, [text(before), *[p for _, _, p in numbered], text(after)], skip)
    finally:
        removed_folder(spark, folder)


@dataclass
class Part:
    name: str
    out: pa.NativeFile

    def write(self, piece: bytes) -> None:
        self.out.write(piece)


@contextlib.contextmanager
def part_files(folder: str, names: Sequence[str]) -> Iterator[list[Part]]:
    """In a task: parts of this attempt's own, in a folder of a file system that Arrow knows."""
    store, at = file_system(folder)
    store.create_dir(at, recursive=True)
    with contextlib.ExitStack() as open_parts:
        own = [f"{n}-{uuid.uuid4().hex}" for n in names]
        yield [Part(f"{folder}/{n}", open_parts.enter_context(store.open_output_stream(f"{at}/{n}", buffer_size=COPIED))) for n in own]


def write_bytes(pieces: DataFrame, path: str) -> None:
    """One file of the binary values in ``pieces``, its only column, in the order of its partitions; nulls are left out."""
    spark, folder = pieces.sparkSession, staging(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        with part_files(folder, [str(own)]) as (part,):
            for batch in batches:
                for piece in batch.column(0):
                    part.write(piece.as_py() or b"")
        yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([part.name])], ["part", "name"])

    try:
        written = sorted(tuple(r) for r in pieces.mapInArrow(run, "part long, name string").collect())  # a row per partition
        join_parts(spark, path, [name for _, name in written])
    finally:
        removed_folder(spark, folder)
