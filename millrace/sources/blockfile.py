"""The block format: self-describing binary tables, several to a file, read and written.

A block is an infinite float, the integer 1, eight unsigned integers (version, sizes of attributes, columns, data
and one row, numbers of attributes, columns and rows), then attributes, columns and rows of fixed width; texts
are NUL-terminated and padded to four bytes.
"""

from __future__ import annotations

import itertools
import math
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

# Fixed values of the format.
VERSION = 3
INT, UINT, FLOAT, CHAR = 1, 2, 3, 4
KINDS = {(INT, 4): ("i", "int"), (INT, 8): ("q", "long"), (UINT, 4): ("I", "long"), (FLOAT, 4): ("f", "float"), (FLOAT, 8): ("d", "double")}
OF_SPARK = {"tinyint": (INT, 4), "smallint": (INT, 4), "int": (INT, 4), "bigint": (INT, 8), "long": (INT, 8), "float": (FLOAT, 4), "double": (FLOAT, 8)}


@dataclass
class Block:
    attributes: list[tuple[str, object]]
    columns: list[tuple[str, int, int]]  # name, kind, width
    rows: list[tuple]


def _pad(n: int) -> int:
    return -(-n // 4) * 4


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def _value(kind: int, raw: bytes):
    return _text(raw) if kind == CHAR else struct.unpack("<" + KINDS[kind, len(raw)][0], raw)[0]


def decode(data: bytes) -> Iterator[Block]:
    """The blocks that are laid end to end in ``data``. A wrong mark, version or length is an error."""
    at = 0
    while at < len(data):
        if len(data) - at < 40:
            raise ValueError("block cut off in its header")
        mark, is_block, version, n_attr, n_col, n_data, row_size, attrs, cols, rows = struct.unpack_from("<fi8I", data, at)
        if math.isfinite(mark) or is_block != 1:
            raise ValueError("not a block")
        if version != VERSION:
            raise ValueError(f"block version {version}, not {VERSION}")
        at += 40
        if len(data) - at < n_attr + n_col + n_data:
            raise ValueError("block cut off")
        own, base = [], at + 4 * attrs
        for _ in range(attrs):
            kind, name, size = struct.unpack_from("<3I", data, base)
            own.append((_text(data[base + 12 : base + 12 + name]), _value(kind, data[base + 12 + name : base + 12 + name + size])))
            base += 12 + name + size
        columns, base = [], at + n_attr + 8 * cols
        for _ in range(cols):
            kind, size, name = struct.unpack_from("<3I", data, base)
            columns.append((_text(data[base + 12 : base + 12 + name]), kind, size))
            base += 12 + name
        layout = struct.Struct("<" + "".join(f"{size}s" if kind == CHAR else KINDS[kind, size][0] for _, kind, size in columns))
        texts = [i for i, (_, kind, _) in enumerate(columns) if kind == CHAR]
        start, found = at + n_attr + n_col, []
        for i in range(rows):
            row = list(layout.unpack_from(data, start + i * row_size))
            for k in texts:
                row[k] = _text(row[k])
            found.append(tuple(row))
        yield Block(own, columns, found)
        at += n_attr + n_col + n_data


def encode(columns: Sequence[tuple[str, int, int]], rows: Sequence[Sequence], attributes: Sequence[tuple[str, object]] = ()) -> bytes:
    """One block. Missing values are zero or empty; texts must fit their column's width."""
    attr_part, offsets = b"", []
    for name, value in attributes:
        raw = value.encode() if isinstance(value, str) else struct.pack("<q" if isinstance(value, int) and abs(value) >> 31 else "<i" if isinstance(value, int) else "<d", value)
        kind = CHAR if isinstance(value, str) else INT if isinstance(value, int) else FLOAT
        size = _pad(len(raw) + 1) if kind == CHAR else len(raw)
        label = name.encode() + b"\0"
        offsets.append(4 * len(attributes) + len(attr_part))
        attr_part += struct.pack("<3I", kind, _pad(len(label)), size) + label.ljust(_pad(len(label)), b"\0") + raw.ljust(size, b"\0")
    attr_part = struct.pack(f"<{len(offsets)}i", *offsets) + attr_part
    col_part, col_offsets, cells, width = b"", [], [], 0
    for name, kind, size in columns:
        label = name.encode() + b"\0"
        col_offsets.append(8 * len(columns) + len(col_part))
        cells.append(width)
        width += size
        col_part += struct.pack("<3I", kind, size, _pad(len(label))) + label.ljust(_pad(len(label)), b"\0")
    col_part = struct.pack(f"<{2 * len(columns)}I", *col_offsets, *cells) + col_part
    layout = struct.Struct("<" + "".join(f"{size}s" if kind == CHAR else KINDS[kind, size][0] for _, kind, size in columns))
    body = bytearray()
    for row in rows:
        values = []
        for (name, kind, size), v in zip(columns, row):
            missing = v is None or (isinstance(v, float) and math.isnan(v) and kind != FLOAT)
            if kind == CHAR:
                raw = b"" if missing else str(v).encode()
                if len(raw) >= size:
                    raise ValueError(f"{name}: {len(raw)} bytes do not fit {size - 1}")
                values.append(raw)
            else:
                values.append((0 if missing else int(v)) if kind != FLOAT else (0.0 if v is None else float(v)))
        body += layout.pack(*values)
    head = struct.pack("<fi8I", math.inf, 1, VERSION, len(attr_part), len(col_part), len(body), width, len(attributes), len(columns), len(rows))
    return head + attr_part + col_part + bytes(body)


def columns_of(schema: StructType, width: int = 255) -> list[tuple[str, int, int]]:
    out = []
    for f in schema:
        kind = f.dataType.simpleString()
        out.append((f.name, *OF_SPARK[kind]) if kind in OF_SPARK else (f.name, CHAR, _pad(width + 1)))
    return out


def schema_of(block: Block) -> str:
    return ", ".join(f"`{n}` {'string' if k == CHAR else KINDS[k, s][1]}" for n, k, s in block.columns)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path in it; a URL that Arrow does not know is a ValueError."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise ValueError(f"no file system for {path}") from e


#: Ranges for each core that a large input is read in, and the least and most bytes that such a range has.
RANGES, RANGE_BYTES = 8, (1 << 16, 32 << 20)


def paced(total: int, most: int, cores: int) -> int:
    """Bytes of a range when ``total`` are read: ``most``, or more where that would be far more tasks than cores need."""
    low, high = RANGE_BYTES
    step = min(high, total // (RANGES * max(1, cores)))
    return max(most, step) if step > low else most


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The block files at a path: one file, or all those of a folder, by name."""
    store, at = file_system(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return store, [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_")) and not f.base_name.endswith(".tmp")]
    return store, sorted(found)


@dataclass
class Place:
    """A block in a file: where its rows begin, how many and how wide they are, and its columns."""

    start: int
    rows: int
    width: int
    columns: list[tuple[str, int, int]]


def places(store: fs.FileSystem, path: str) -> Iterator[Place]:
    """The blocks of a file by their headers alone; rows are skipped, not read."""
    size, at = store.get_file_info(path).size, 0
    with store.open_input_file(path) as f:
        while at < size:
            head = f.read_at(40, at)
            if len(head) < 40:
                raise ValueError("block cut off in its header")
            mark, is_block, version, n_attr, n_col, n_data, row_size, _, cols, rows = struct.unpack("<fi8I", head)
            if math.isfinite(mark) or is_block != 1:
                raise ValueError("not a block")
            if version != VERSION:
                raise ValueError(f"block version {version}, not {VERSION}")
            at += 40
            if size - at < n_attr + n_col + n_data:
                raise ValueError("block cut off")
            part, base, columns = f.read_at(n_col, at + n_attr), 8 * cols, []
            for _ in range(cols):
                kind, width, name = struct.unpack_from("<3I", part, base)
                columns.append((_text(part[base + 12 : base + 12 + name]), kind, width))
                base += 12 + name
            yield Place(at + n_attr + n_col, rows, row_size, columns)
            at += n_attr + n_col + n_data


@dataclass
class Rows(InputPartition):
    """Rows low to high of a block."""

    file: str
    block: int
    place: Place
    low: int
    high: int


#: Comparisons that a scan can make on numbers before it makes rows.
_TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class _BlockReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, most: int, cores: int = 0):
        self.path, self.schema, self.most, self.cores, self.tests = path, schema, most, cores, []

    def partitions(self) -> list[Rows]:
        store, files = _files(self.path)
        out, names = [], [f.name for f in self.schema if not f.name.startswith("__")]
        most = paced(sum(store.get_file_info(f).size for f in files), self.most, self.cores) if self.cores else self.most
        for file in files:
            for k, p in enumerate(places(store, file)):
                if [n for n, _, _ in p.columns] != names:
                    raise ValueError(f"{file}: block {k} has other columns")
                step = max(1, most // max(1, p.width))
                out += [Rows(file, k, p, low, min(low + step, p.rows)) for low in range(0, p.rows, step)]
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        kinds = [(n, f"S{size}" if kind == CHAR else f"<{KINDS[kind, size][0]}") for n, kind, size in part.place.columns]
        layout = np.dtype({"names": [n for n, _ in kinds], "formats": [k for _, k in kinds], "offsets": np.cumsum([0, *(size for _, _, size in part.place.columns)])[:-1].tolist(), "itemsize": part.place.width})
        with store.open_input_file(part.file) as f:
            for low in range(part.low, part.high, 1 << 14):
                n = min(1 << 14, part.high - low)
                rows = np.frombuffer(f.read_at(n * part.place.width, part.place.start + low * part.place.width), layout)
                keep = np.ones(n, bool)
                for name, test, value in self.tests:
                    keep &= test(rows[name], value)
                rows, at = rows[keep], np.flatnonzero(keep) + low
                cells = [pa.array([_text(v) for v in rows[c].tolist()], pa.string()) if kind == CHAR else pa.array(rows[c].astype(np.int64) if kind == UINT else np.ascontiguousarray(rows[c])) for c, kind, _ in part.place.columns]
                more = [pa.array([part.file] * len(rows), pa.string()), pa.array(np.full(len(rows), part.block, np.int32)), pa.array(at.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*cells, *more], [*(c for c, _, _ in part.place.columns), "__file", "__block", "__row"])


class _FilteringReader(_BlockReader):
    """Spark asks for this only where ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters):  # noqa: N802 - a name that Spark calls
        numbers = {f.name for f in self.schema if f.dataType.simpleString() != "string" and not f.name.startswith("__")}
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in numbers and isinstance(f.value, int | float):
                self.tests.append((f.attribute[0], _TESTS[type(f)], f.value))
            else:
                yield f


def read_blocks(spark: SparkSession, path: str, most: int = 32 << 20) -> DataFrame:
    """All blocks of the files at ``path``, with __file, __block and __row; the first file's first block gives the columns.

    Blocks of other columns are an error. In a file system that Arrow knows, a file is read in ranges of rows of at most
    ``most`` bytes (of more if the input is large: ``paced``) by several tasks; in any other, Spark reads it whole, a file per task. Comparisons of numbers are made by
    the scan if the session lets Python sources filter, as ``plans.session`` does.
    """
    try:
        file_system(path)
    except ValueError:
        return read_whole_blocks(spark, path)
    spark.dataSource.register(BlockDataSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("block").options(bytes=str(most), filters=filters, cores=str(spark.sparkContext.defaultParallelism)).load(path)


def read_whole_blocks(spark: SparkSession, path: str) -> DataFrame:
    """All blocks of the files at ``path``, with __file, __block and __row; the first file's first block gives the columns.

    Files are read by Spark and decoded on the executors, a file per row; blocks of other columns are an error.
    """
    files = spark.read.format("binaryFile").load(path)
    first = next(decode(bytes(files.orderBy("path").select("content").first()[0])))
    names = [n for n, _, _ in first.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                for k, b in enumerate(decode(bytes(content))):
                    if [n for n, _, _ in b.columns] != names:
                        raise ValueError(f"{file}: block {k} has other columns")
                    out = pd.DataFrame(b.rows, columns=names)
                    out["__file"], out["__block"], out["__row"] = file, k, range(len(out))
                    yield out

    return files.select("path", "content").mapInPandas(run, schema_of(first) + ", __file string, __block int, __row long")


class BlockDataSource(DataSource):
    """``format("block")``: reads blocks by ranges of their rows (option ``bytes``: the most a task reads, 32 MB by
    default), numeric comparisons pushed down; writes a file per partition, in blocks of BLOCK_ROWS rows."""

    @classmethod
    def name(cls) -> str:
        return "block"

    def schema(self) -> str:
        store, files = _files(self.options["path"])
        first = next((p for f in files for p in places(store, f)), None)
        if first is None:
            raise ValueError(f"{self.options['path']}: no block gives the columns")
        return schema_of(Block([], first.columns, [])) + ", __file string, __block int, __row long"

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("filters") == "true" else _BlockReader
        return kind(self.options["path"], schema, int(self.options.get("bytes", str(32 << 20))), int(self.options.get("cores", "0")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BlockWriter(self.options["path"], schema, int(self.options.get("width", "255")))


#: Rows of a block that is written; a partition of more is several blocks end to end.
BLOCK_ROWS = 1 << 16


class _BlockWriter(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, width: int):
        self.path, self.schema, self.width = path, schema, width

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, at = file_system(self.path)
        store.create_dir(at, recursive=True)
        name, columns, rows = f"{at}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.b", columns_of(self.schema, self.width), iter(iterator)
        with store.open_output_stream(name + ".tmp") as f:
            f.write(encode(columns, [tuple(r) for r in itertools.islice(rows, BLOCK_ROWS)]))
            while more := [tuple(r) for r in itertools.islice(rows, BLOCK_ROWS)]:
                f.write(encode(columns, more))
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages) -> None:
        store, _ = file_system(self.path)
        for m in messages:
            store.move(m.name + ".tmp", m.name)

    def abort(self, messages) -> None:
        store, _ = file_system(self.path)
        for m in messages:
            if m is not None and store.get_file_info(m.name + ".tmp").type == fs.FileType.File:
                store.delete_file(m.name + ".tmp")
