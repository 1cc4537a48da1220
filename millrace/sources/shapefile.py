"""ESRI shapefiles: geometry (.shp) with its attribute table (.dbf), read by Spark and parsed on the executors."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.session import checkpointed
from millrace.sources.blockfile import file_system, paced
from millrace.sources.single import join_parts, part_files, removed_folder, staging

# Fixed values of the format.
POINT, ARC, POLYGON, MULTIPOINT = 1, 3, 5, 8
KINDS = {POINT: "points", ARC: "line_strip", POLYGON: "line_loop", MULTIPOINT: "points"}

#: Bytes of geometry that a task reads, and entries of an index that are held at a time.
SHAPE_BYTES, INDEX_ENTRIES = 32 << 20, 1 << 20


def read_dbf(data: bytes) -> tuple[list[tuple[str, str, int, int]], list[tuple]]:
    """Fields (name, type letter, width, decimals) and rows; numbers become int or float, empty ones None."""
    rows, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0", 1)[0].decode("latin-1")
        fields.append((name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    out = []
    for i in range(rows):
        at, row = head + i * width + 1, []
        for _, kind, size, decimals in fields:
            raw = data[at : at + size].decode("latin-1").strip(" \0")
            at += size
            if kind in "NF":
                row.append((float(raw) if decimals or kind == "F" else int(float(raw))) if raw and raw != "*" * len(raw) else None)
            else:
                row.append(raw)
        out.append(tuple(row))
    return fields, out


def read_shp(data: bytes) -> Iterator[tuple[int, int, list[list[tuple[float, float]]]]]:
    """(record, type, parts) of each record of a file; a null shape has no parts."""
    yield from shp_records(data[100 : struct.unpack_from(">I", data, 24)[0] * 2])


def shp_records(data: bytes, k: int = 0) -> Iterator[tuple[int, int, list[list[tuple[float, float]]]]]:
    """The records, numbered from ``k``, that are laid end to end in ``data``."""
    at = 0
    while at + 12 <= len(data):
        size = struct.unpack_from(">I", data, at + 4)[0] * 2
        kind = struct.unpack_from("<I", data, at + 8)[0] % 10
        base, parts = at + 12, []
        if kind == POINT:
            parts = [[struct.unpack_from("<2d", data, base)]]
        elif kind == MULTIPOINT:
            n = struct.unpack_from("<I", data, base + 32)[0]
            parts = [[struct.unpack_from("<2d", data, base + 36 + 16 * i) for i in range(n)]]
        elif kind in (ARC, POLYGON):
            n, m = struct.unpack_from("<2I", data, base + 32)
            first = [*struct.unpack_from(f"<{n}I", data, base + 40), m]
            xy = struct.unpack_from(f"<{2 * m}d", data, base + 40 + 4 * n)
            parts = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(first, first[1:])]
        yield k, kind, parts
        at, k = at + 8 + size, k + 1


def _spark_type(kind: str, decimals: int) -> str:
    return ("double" if decimals or kind == "F" else "int") if kind in "NF" else "string"


@dataclass(frozen=True)
class Wanted:
    """What is kept of the vertices while records are parsed."""

    index: tuple[int, ...]
    names: tuple[str, ...]
    row_id: int | None
    part_id: int | None
    limit: int | None

    def frames(self, records: Iterator[tuple], table: Sequence[tuple], first: int = 0, seq: int = 0) -> Iterator[pd.DataFrame]:
        """Rows of records numbered from ``first``, the next kept vertex being number ``seq`` of its file."""
        rows = []
        for k, kind, parts in records:
            if self.row_id is not None and k != self.row_id:
                continue
            own = tuple(table[k - first][i] for i in self.index) if k - first < len(table) else (None,) * len(self.index)
            for p, part in enumerate(parts):
                if self.part_id is not None and p != self.part_id:
                    continue
                for x, y in part:
                    if self.limit is not None and seq >= self.limit:
                        break
                    rows.append((k, p, kind, seq, x, y, *own))
                    seq += 1
            if len(rows) > 50_000:
                yield pd.DataFrame(rows, columns=[*_BASE, *self.names])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=[*_BASE, *self.names])


def read_shapefile(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, row_id: int | None = None, part_id: int | None = None, limit: int | None = None, most: int = SHAPE_BYTES
) -> DataFrame:
    """A row per vertex: shape_row_id, shape_part_id, shape_part_type, seq, x, y and the attributes.

    ``path`` names the .shp or .dbf file. ``columns``, ``row_id``, ``part_id`` and ``limit`` (of a file's vertices) are
    applied while parsing. Records without geometry give no rows. A file is read by several tasks: its index (.shx)
    gives ranges of records of at most ``most`` bytes, whose vertices are counted first, so that each range knows its
    place. Files in a file system that Arrow does not know are read whole, a file per task.
    """
    stem = path.rsplit(".", 1)[0]
    load = lambda ext: spark.read.format("binaryFile").load(f"{stem}.{ext}")
    listed = {r["path"].rsplit(".", 1)[0]: r["length"] for r in load("shp").select("path", "length").collect()}  # a row per file
    tables = sorted(r["path"] for r in load("dbf").select("path").collect())
    try:
        with _opened(tables[0]) as f:
            head = f.read(1 << 16)
    except ValueError:
        head = None
    whole = head is None
    if whole:
        head = bytes(load("dbf").orderBy("path").select(F.substring("content", 1, 1 << 16)).first()[0])
    fields, _ = read_dbf(head[:4] + struct.pack("<I", 0) + head[8:])
    chosen = [f for f in fields if columns is None or f[0] in columns]
    schema = "shape_row_id int, shape_part_id int, shape_part_type int, seq long, x double, y double"
    schema += "".join(f", `{n}` {_spark_type(k, d)}" for n, k, _, d in chosen)
    names = [f[0] for f in fields]
    wanted = Wanted(tuple(names.index(f[0]) for f in chosen), tuple(f[0] for f in chosen), row_id, part_id, limit)
    if whole:
        named = lambda ext: load(ext).select(F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.col("content").alias(ext))

        def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for shp, dbf in zip(frame["shp"], frame["dbf"]):
                    yield from wanted.frames(read_shp(bytes(shp)), read_dbf(bytes(dbf))[1])

        return named("shp").join(named("dbf"), "stem").select("shp", "dbf").mapInPandas(parsed, schema)  # a pair of files each

    having = {t.rsplit(".", 1)[0] for t in tables}
    pairs = [s for s in listed if s in having]
    most = paced(sum(listed.values()), most, spark.sparkContext.defaultParallelism)

    def extents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own in frame["stem"]:
                yield pd.DataFrame(list(shape_extents(own, most)), columns=["first", "low", "high"]).assign(stem=own)[["stem", "first", "low", "high"]]

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for own, first, low, high in frame[["stem", "first", "low", "high"]].itertuples(index=False):
                if row_id is None and part_id is None:
                    found.append(_vertices(own, low, high))
                    continue
                kept = (len(p) for k, _, parts in _range(own, low, high, first) if row_id in (None, k) for i, p in enumerate(parts) if part_id in (None, i))
                found.append(sum(kept))
            yield frame.assign(n=found)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, first, low, high, seq, last in frame[["stem", "first", "low", "high", "seq", "last"]].itertuples(index=False):
                yield from wanted.frames(_range(own, low, high, first), _rows(own, first, last), first, seq)

    tasks = max(1, sum(-(-n // most) for n in listed.values()))
    ranges = spark.createDataFrame([(s,) for s in pairs], "stem string").repartition(max(1, len(pairs))).mapInPandas(extents, "stem string, first long, low long, high long")
    sized = ranges.repartition(tasks).mapInPandas(counted, "stem string, first long, low long, high long, n long")
    w = Window.partitionBy("stem").orderBy("first")  # a row per range
    placed = sized.withColumns({"seq": F.sum("n").over(w) - F.col("n"), "last": F.lead("first").over(w)}).na.fill(-1, ["last"])
    if limit is not None:
        placed = placed.where(F.col("seq") < limit)
    return placed.repartition(tasks).mapInPandas(read, schema)


def _opened(file: str):
    store, at = file_system(file)
    return store.open_input_file(at)


def _starts(stem: str, shp, size: int) -> Iterator[np.ndarray]:
    """Where records begin, some at a time, by the index, or by the records' own heads where there is none."""
    try:
        with _opened(f"{stem}.shx") as shx:
            shx.seek(100)
            while len(entries := shx.read(8 * INDEX_ENTRIES)) >= 8:
                yield np.frombuffer(entries, ">u4", len(entries) // 8 * 2)[::2].astype(np.int64) * 2
            return
    except FileNotFoundError:
        pass
    found, at = [], 100
    while at + 12 <= size:
        found.append(at)
        at += 8 + 2 * struct.unpack(">I", shp.read_at(4, at + 4))[0]
        if len(found) == INDEX_ENTRIES:
            yield np.asarray(found, np.int64)
            found = []
    yield np.asarray(found, np.int64)


def shape_extents(stem: str, most: int) -> Iterator[tuple[int, int, int]]:
    """(first record, low, high): ranges of whole records of at most ``most`` bytes, or of one record."""
    with _opened(f"{stem}.shp") as shp:
        size = min(struct.unpack(">I", shp.read_at(4, 24))[0] * 2, shp.size())
        first, held = 0, np.empty(0, np.int64)
        for some in _starts(stem, shp, size):
            held, at = np.concatenate([held, some]), 0
            while at < len(held) and held[-1] >= held[at] + most:
                following = max(at + 1, int(np.searchsorted(held, held[at] + most, "left")) - 1)
                yield first + at, int(held[at]), int(held[following])
                at = following
            first, held = first + at, held[at:]
        if len(held):
            yield first, int(held[0]), size


def _range(stem: str, low: int, high: int, first: int) -> Iterator[tuple]:
    with _opened(f"{stem}.shp") as f:
        data = f.read_at(high - low, low)
    return shp_records(data, first)


def _vertices(stem: str, low: int, high: int) -> int:
    """How many vertices the records of a range have, by their heads alone."""
    with _opened(f"{stem}.shp") as f:
        data = f.read_at(high - low, low)
    at, n = 0, 0
    while at + 12 <= len(data):
        kind = struct.unpack_from("<I", data, at + 8)[0] % 10
        n += 1 if kind == POINT else struct.unpack_from("<I", data, at + (44 if kind == MULTIPOINT else 48))[0] if kind in (MULTIPOINT, ARC, POLYGON) else 0
        at += 8 + 2 * struct.unpack_from(">I", data, at + 4)[0]
    return n


def _rows(stem: str, first: int, last: int) -> list[tuple]:
    """Rows ``first`` to ``last`` (-1: the end) of a table."""
    with _opened(f"{stem}.dbf") as f:
        rows, head, width = struct.unpack("<IHH", f.read_at(8, 4))
        n = max(0, (rows if last < 0 else min(last, rows)) - first)
        data = f.read_at(head, 0)
        return read_dbf(data[:4] + struct.pack("<I", n) + data[8:] + f.read_at(n * width, head + first * width))[1]


_BASE = ["shape_row_id", "shape_part_id", "shape_part_type", "seq", "x", "y"]


def _head(kind: int, words: int, box: Sequence[float]) -> bytes:
    return struct.pack(">7I", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2I4d4d", 1000, kind, *box, 0, 0, 0, 0)


def _table_head(fields: Sequence[tuple[str, str, int, int]], count: int) -> bytes:
    out = struct.pack("<4BIHH20x", 3, 124, 1, 1, count, 33 + 32 * len(fields), 1 + sum(f[2] for f in fields))
    for name, letter, size, decimals in fields:
        out += name.encode("latin-1")[:10].ljust(11, b"\0") + letter.encode() + b"\0" * 4 + bytes([size, decimals]) + b"\0" * 14
    return out + b"\x0d"


def _record(pieces: Sequence[tuple[np.ndarray, np.ndarray, list]], fields: Sequence[tuple[str, str, int, int]], kind: int) -> tuple:
    """(geometry, attributes, bounds) of a shape from its vertices, their parts and the attributes, in pieces in order."""
    xy, part = (np.concatenate([p[k] for p in pieces]) if len(pieces) > 1 else pieces[0][k] for k in (0, 1))
    box = (*xy.min(axis=0), *xy.max(axis=0))
    if kind == POINT:
        body = struct.pack("<I2d", kind, *xy[0])
    elif kind == MULTIPOINT:
        body = struct.pack("<I4dI", kind, *box, len(xy)) + xy.tobytes()
    else:
        starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1]).astype("<u4")
        body = struct.pack("<I4d2I", kind, *box, len(starts), len(xy)) + starts.tobytes() + xy.tobytes()
    row = b" "
    for (_, letter, size, decimals), v in zip(fields, pieces[0][2]):
        text = "" if pd.isna(v) else f"{v:.{decimals}f}" if letter == "N" and decimals else str(int(v)) if letter == "N" else str(v)
        row += (text.rjust(size) if letter == "N" else text.ljust(size)).encode("latin-1", "replace")[:size]
    return body, row, *map(float, box)


def write_shapefile(df: DataFrame, path: str, attributes: Sequence[str] = (), order: str = "seq", kind: int = POLYGON) -> None:
    """One shapefile of the table's shapes, in order of their ids.

    Vertices are sorted by ranges of shapes; each task makes the records of its range, whose counts and sizes give every
    range its first number and offset; tasks write parts of the three files, which are joined. A shape is one record, made
    in one task. Attributes are those of a shape's first vertex; vertices without a shape_row_id are left out, and those
    of a null part come first.
    """
    spark, types, stem = df.sparkSession, dict(df.dtypes), path.rsplit(".", 1)[0]
    fields = [(a, "N", 18, 0) if types[a] in ("int", "bigint") else (a, "N", 24, 8) if types[a] in ("double", "float") else (a, "C", 80, 0) for a in attributes]
    whole = [F.col(a).cast("string").alias(a) if types[a] in ("int", "bigint") else F.col(a) for a in attributes]  # pandas would make decimals of them
    vertices = df.where("shape_row_id is not null").select("shape_row_id", F.coalesce("shape_part_id", F.lit(-1)).alias("shape_part_id"), F.col(order).alias("__order"), "x", "y", *whole)
    ranged = vertices.repartitionByRange("shape_row_id").sortWithinPartitions("shape_row_id", "shape_part_id", "__order").drop("__order")

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        names = ["body", "row", "x0", "y0", "x1", "y1"]
        for frame in frames:
            ids, out = frame["shape_row_id"].to_numpy(), []
            # columns as arrays, once for all shapes of a frame
            xy, part, told = frame[["x", "y"]].to_numpy("<f8"), frame["shape_part_id"].to_numpy(), [frame[f[0]].tolist() for f in fields]
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if held and ids[low] != last:
                    out.append(_record(held, fields, kind))
                    held = []
                held.append((xy[low:high], part[low:high], [c[low] for c in told]))
                last = ids[low]
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([_record(held, fields, kind)], columns=names)

    made = checkpointed(ranged.mapInPandas(records, "body binary, row binary, x0 double, y0 double, x1 double, y1 double"))
    bounds = [F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")]
    totals = made.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum(F.length("body") / 2 + 4).cast("long").alias("words"), *[b.alias(f"b{i}") for i, b in enumerate(bounds)]).orderBy("part").collect()  # a row per range
    first, count, words = {}, 0, 50
    for r in totals:
        first[r["part"]] = (count, words)
        count, words = count + r["n"], words + r["words"]
    box = [pick(r[f"b{i}"] for r in totals) if totals else 0.0 for i, pick in enumerate((min, min, max, max))]
    folder = staging(spark)

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        if own not in first:
            return
        number, at = first[own]
        with part_files(folder, [f"{own}.{ext}" for ext in ("shp", "shx", "dbf")]) as (shp, shx, dbf):
            for frame in frames:
                for body, row in zip(frame["body"], frame["row"]):
                    number += 1
                    shp.write(struct.pack(">2I", number, len(body) // 2))
                    shp.write(body)
                    shx.write(struct.pack(">2I", at, len(body) // 2))
                    dbf.write(row)
                    at += 4 + len(body) // 2
        yield pd.DataFrame({"part": [own], "names": [[shp.name, shx.name, dbf.name]]})

    try:
        written = sorted((r["part"], r["names"]) for r in made.select("body", "row").mapInPandas(parts, "part int, names array<string>").collect())  # a row per range
        heads = (("shp", _head(kind, words, box), b""), ("shx", _head(kind, 50 + 4 * count, box), b""), ("dbf", _table_head(fields, count), b"\x1a"))
        for k, (ext, head, foot) in enumerate(heads):
            join_parts(spark, f"{stem}.{ext}", [head, *[names[k] for _, names in written], foot])
    finally:
        removed_folder(spark, folder)
