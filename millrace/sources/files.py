"""Elevation grids, SVG, KML, OSM-PBF and sound files. Spark reads the bytes, pandas batches parse them on executors.

Each parser is a plain function of bytes that yields tuples, so it can be tested without Spark.
"""

from __future__ import annotations

import io
import itertools
import math
import re
import struct
import wave
import zlib
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.sources.blockfile import file_system, paced

# Default ramp of elevations (metres, red, green, blue).
RAMP = ((0.0, 0.2, 0.4, 0.7), (1.0, 0.3, 0.6, 0.3), (200.0, 0.6, 0.7, 0.4), (1000.0, 0.7, 0.6, 0.5), (3000.0, 1.0, 1.0, 1.0))


def parsed(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]], schema: str, file: str | None = None) -> DataFrame:
    """The rows that ``parse`` finds in each file, a task per group of files; ``file`` names a column for the file's path."""
    names = [c.split()[0] for c in schema.split(", ")]
    schema += f", {file} string" if file else ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, content in zip(frame["path"], frame["content"]):
                named = lambda held: pd.DataFrame(held, columns=names).assign(**({file: source} if file else {}))  # noqa: B023, E731
                held = []
                for row in parse(bytes(content)):
                    held.append(row)
                    if len(held) >= 50_000:
                        yield named(held)
                        held = []
                if held:
                    yield named(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


# Elevation


def parse_dem(data: bytes) -> Iterator[tuple[int, int, float, float, float]]:
    """(column, row, x, y, z) of a one-degree elevation model: profiles from south to north, x and y in degrees."""
    number = lambda raw: float(raw.decode("ascii").strip().replace("D", "E").replace("d", "e") or 0)
    if int(data[528:534]) != 3 or int(data[534:540]) != 2 or int(data[540:546]) != 4:
        raise ValueError("expected arc seconds, metres and four sides")
    step_x, step_y, step_z = (number(data[816 + 12 * k : 828 + 12 * k]) for k in range(3))
    profiles = int(data[858:864])
    at = 1024
    for _ in range(profiles):
        column = int(data[at + 6 : at + 12])
        n = int(data[at + 12 : at + 18])
        x0, y0 = number(data[at + 24 : at + 48]), number(data[at + 48 : at + 72])
        base = number(data[at + 72 : at + 96])
        place, left = at + 144, 146
        for k in range(n):
            if k and k >= left and (k - left) % 170 == 0:
                at += 1024
                place = at
            z = int(data[place : place + 6])
            place += 6
            yield column - 1, k, x0 / 3600, (y0 + k * step_y) / 3600, base + z * step_z
        at += 1024


def read_dem(spark: SparkSession, path: str) -> DataFrame:
    """A row per sample: col, row, x, y, z and the file it is of."""
    return parsed(spark, path, parse_dem, "col int, row int, x double, y double, z double", "file")


def elevation_colours(df: DataFrame, ramp=RAMP, water: float | None = None, shade: float = 0.5) -> DataFrame:
    """Colours by linear interpolation in the ramp, lit by the slope to the four neighbours; water is the first colour."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    z = F.col("z")

    def part(k: int):
        out = F.lit(float(ramp[-1][k]))
        for low, high in reversed(list(zip(ramp, ramp[1:]))):
            share = (z - low[0]) / (high[0] - low[0])
            out = F.when(z < high[0], low[k] + share * (high[k] - low[k])).otherwise(out)
        out = F.when(z < ramp[0][0], float(ramp[0][k])).otherwise(out)
        return F.when(z <= water, float(ramp[0][k])).otherwise(out) if water is not None else out

    own = ["file"] if "file" in df.columns else []  # the neighbours are of one model
    by_row, by_col = Window.partitionBy(*own, "row").orderBy("col"), Window.partitionBy(*own, "col").orderBy("row")
    slope = F.coalesce(F.lead("z").over(by_row), z) - F.coalesce(F.lag("z").over(by_row), z) + F.coalesce(F.lead("z").over(by_col), z) - F.coalesce(F.lag("z").over(by_col), z)
    light = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - shade * F.atan(slope / 100) / (math.pi / 2)))
    lit = df.withColumn("__light", light)
    return lit.withColumns({n: part(k) * F.col("__light") for n, k in (("red", 1), ("green", 2), ("blue", 3))}).withColumn("alpha", F.lit(1.0)).drop("__light")


# SVG and KML

SHAPE = "shape_row_id int, shape_part_id int, seq int, x double, y double, red double, green double, blue double, alpha double"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _matrix(text: str | None) -> tuple[float, ...]:
    """(a, b, c, d, e, f) of a list of transforms."""
    out = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    for name, args in re.findall(r"(\w+)\s*\(([^)]*)\)", text or ""):
        v = [float(x) for x in re.findall(r"[-+]?[\d.]+(?:[eE][-+]?\d+)?", args)]
        if name == "matrix" and len(v) == 6:
            m = tuple(v)
        elif name == "translate":
            m = (1.0, 0.0, 0.0, 1.0, v[0], v[1] if len(v) > 1 else 0.0)
        elif name == "scale":
            m = (v[0], 0.0, 0.0, v[1] if len(v) > 1 else v[0], 0.0, 0.0)
        else:
            continue
        out = _times(out, m)
    return out


def _times(p: tuple, q: tuple) -> tuple[float, ...]:
    a, b, c, d, e, f = p
    return (a * q[0] + c * q[1], b * q[0] + d * q[1], a * q[2] + c * q[3], b * q[2] + d * q[3], a * q[4] + c * q[5] + e, b * q[4] + d * q[5] + f)


def _hex(text: str | None) -> tuple[float, float, float] | None:
    found = re.fullmatch(r"#([0-9a-fA-F]{6})", (text or "").strip())
    return tuple(int(found[1][k : k + 2], 16) / 255 for k in (0, 2, 4)) if found else None


def svg_path(text: str) -> list[list[tuple[float, float]]]:
    """Parts of a path of moves, lines (also horizontal and vertical), curves (their end points) and closings."""
    parts: list[list[tuple[float, float]]] = []
    x = y = 0.0
    takes = {"M": 2, "L": 2, "H": 1, "V": 1, "Q": 4, "C": 6, "S": 4, "T": 2, "A": 7}
    for letter, args in re.findall(r"([MmLlHhVvQqCcSsTtAaZz])([^MmLlHhVvQqCcSsTtAaZz]*)", text):
        kind, relative = letter.upper(), letter.islower()
        if kind == "Z":
            if parts and parts[-1]:
                parts[-1].append(parts[-1][0])
                x, y = parts[-1][0]
            continue
        v = [float(n) for n in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", args)]
        for k in range(0, len(v) - takes[kind] + 1, takes[kind]):
            if kind == "H":
                x = v[k] + (x if relative else 0)
            elif kind == "V":
                y = v[k] + (y if relative else 0)
            else:
                nx, ny = v[k + takes[kind] - 2 : k + takes[kind]]
                x, y = (x + nx, y + ny) if relative else (nx, ny)
            if kind == "M" and k == 0:
                parts.append([])
            elif not parts:
                parts.append([])
            parts[-1].append((x, y))
    return parts


def parse_svg(data: bytes, bbox: tuple[float, float, float, float] | None = None) -> Iterator[tuple]:
    """A row per vertex of paths and per text position; clip paths, clipped groups and labels' paths are left out."""
    root = ElementTree.fromstring(data)
    box = [float(v) for v in re.findall(r"[-+]?[\d.]+", root.get("viewBox") or "")]
    fit = (lambda x, y: (x, y)) if not bbox or len(box) != 4 else (lambda x, y: (bbox[0] + (x - box[0]) / box[2] * (bbox[2] - bbox[0]), bbox[1] + (y - box[1]) / box[3] * (bbox[3] - bbox[1])))
    shape = 0

    def walk(node, m, labels):
        nonlocal shape
        tag = _local(node.tag) if isinstance(node.tag, str) else ""
        if tag == "clipPath" or (tag == "g" and node.get("clip-path")):
            return
        m = _times(m, _matrix(node.get("transform")))
        labels = labels or node.get("id") == "Labels"
        place = lambda x, y: fit(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])
        colour = (*(_hex(node.get("fill")) or _hex(node.get("stroke")) or (0.0, 0.0, 0.0)), float(node.get("fill-opacity") or 1))
        if tag == "path" and not labels:
            for p, part in enumerate(svg_path(node.get("d") or "")):
                for k, xy in enumerate(part):
                    yield (shape, p, k, *place(*xy), *colour, tag, "")
            shape += 1
        elif tag in ("tspan", "text") and (node.text or "").strip() and node.get("x"):
            xs = [float(v) for v in re.findall(r"[-+]?[\d.]+", node.get("x"))]
            yield (shape, 0, 0, *place(xs[0], float((re.findall(r"[-+]?[\d.]+", node.get("y") or "0") or ["0"])[0])), *colour, tag, node.text.strip())
            shape += 1
        for child in node:
            yield from walk(child, m, labels)

    yield from walk(root, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), False)


def read_svg(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    return parsed(spark, path, lambda data: parse_svg(data, bbox), SHAPE + ", tag string, text string")


def parse_kml(data: bytes) -> Iterator[tuple]:
    """A row per vertex of each placemark's rings, lines and points; colours (aabbggrr) come from its style."""
    root = ElementTree.fromstring(data)
    text = lambda node, name: next((c.text.strip() for c in node.iter() if _local(c.tag) == name and c.text), "")
    styles = {s.get("id"): text(s, "color") for s in root.iter() if _local(s.tag) == "Style" and s.get("id")}
    marks = [p for p in root.iter() if _local(p.tag) == "Placemark"]
    for shape, mark in enumerate(marks):
        style = text(mark, "styleUrl").removeprefix("#")
        code = text(mark, "color") or styles.get(style, "")
        c = [int(code[k : k + 2], 16) / 255 for k in (0, 2, 4, 6)] if re.fullmatch("[0-9a-fA-F]{8}", code) else [1.0, 0.0, 0.0, 0.0]
        for part, node in enumerate(n for n in mark.iter() if _local(n.tag) == "coordinates"):
            for k, triple in enumerate((node.text or "").split()):
                v = [float(x) for x in triple.split(",")]
                yield shape, part, k, v[0], v[1], c[3], c[2], c[1], c[0], text(mark, "name"), style, text(mark, "description")


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_kml, SHAPE + ", name string, style string, description string")


# OSM


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer: integers and bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def to_varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def to_zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def parse_osm(data: bytes) -> Iterator[tuple]:
    """(kind, id, lat, lon, refs, tags) of nodes, ways and relations; tags as sorted ``key=value`` texts."""
    at = 0
    while at < len(data):
        n = struct.unpack_from(">I", data, at)[0]
        head = dict(fields(data[at + 4 : at + 4 + n]))
        at += 4 + n
        blob, at = data[at : at + head[3]], at + head[3]
        if head[1] != b"OSMData":
            continue
        parts = dict(fields(blob))
        raw = parts[1] if 1 in parts else zlib.decompress(parts[3]) if 3 in parts else None
        if raw is None:
            raise ValueError("only plain and zlib blobs")
        yield from _osm_block(raw)


def osm_extents(f, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole blobs of at most ``most`` bytes (a blob at least), by the blobs' headers alone."""
    size, low, at = f.size(), 0, 0
    while at < size:
        n = struct.unpack(">I", f.read_at(4, at))[0]
        end = at + 4 + n + dict(fields(f.read_at(n, at + 4)))[3]
        if end > size:
            raise ValueError("blob cut off")
        if end - low > most and at > low:
            yield low, at
            low = at
        at = end
    if at > low:
        yield low, at


def osm_blob(items: Iterable[tuple]) -> bytes:
    """A blob of (kind, id, lat, lon, refs), nodes as dense ones and ways; the inverse of ``parse_osm`` without tags."""
    field = lambda k, v: to_varint(k << 3) + to_varint(v) if isinstance(v, int) else to_varint(k << 3 | 2) + to_varint(len(v)) + v

    def steps(values: Iterable[int]) -> bytes:
        values = list(values)
        return b"".join(to_varint(to_zigzag(b - a)) for a, b in zip([0, *values], values))

    items, grain = list(items), 100
    nodes = [i for i in items if i[0] == "node"]
    dense = field(1, steps(i[1] for i in nodes)) + field(8, steps(round(i[2] * 1e9 / grain) for i in nodes)) + field(9, steps(round(i[3] * 1e9 / grain) for i in nodes))
    ways = b"".join(field(3, field(1, i[1]) + field(8, steps(i[4]))) for i in items if i[0] == "way")
    block = field(1, field(1, b"")) + (field(2, field(2, dense)) if nodes else b"") + (field(2, ways) if ways else b"")
    blob = field(2, len(block)) + field(3, zlib.compress(block))
    head = field(1, b"OSMData") + field(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def _osm_block(raw: bytes) -> Iterator[tuple]:
    block = list(fields(raw))
    texts = [v for f, v in fields(dict(block)[1]) if f == 1]
    own = dict((f, v) for f, v in block if f in (17, 19, 20))
    grain, lat0, lon0 = own.get(17, 100), zigzag(own[19] << 1) if 19 in own else 0, zigzag(own[20] << 1) if 20 in own else 0
    text = lambda k: texts[k].decode("utf-8", "replace")
    tags = lambda pairs: sorted(f"{text(k)}={text(v)}" for k, v in pairs)
    degrees = lambda base, v: 1e-9 * (base + grain * v)
    for number, group in block:
        if number != 2:
            continue
        for f, value in fields(group):
            item = dict(fields(value))
            if f == 1:
                yield "node", zigzag(item[1]), degrees(lat0, zigzag(item[8])), degrees(lon0, zigzag(item[9])), [], tags(zip(_packed(item.get(2, b"")), _packed(item.get(3, b""))))
            elif f == 2:
                keys = _packed(item.get(10, b""))
                i = lat = lon = 0
                at = 0
                for a, b, c in zip(_packed(item[1]), _packed(item[8]), _packed(item[9])):
                    i, lat, lon = i + zigzag(a), lat + zigzag(b), lon + zigzag(c)
                    pairs = []
                    while at < len(keys) and keys[at]:
                        pairs.append((keys[at], keys[at + 1]))
                        at += 2
                    at += 1
                    yield "node", i, degrees(lat0, lat), degrees(lon0, lon), [], tags(pairs)
            elif f in (3, 4):
                refs, r = [], 0
                for v in _packed(item.get(8 if f == 3 else 9, b"")):
                    r += zigzag(v)
                    refs.append(r)
                yield "way" if f == 3 else "relation", item[1], None, None, refs, tags(zip(_packed(item.get(2, b"")), _packed(item.get(3, b""))))


_OSM = "kind string, id long, lat double, lon double, refs array<long>, tags array<string>"
#: Bytes of a file that a task reads.
OSM_BYTES = 16 << 20


def read_osm(spark: SparkSession, path: str, most: int = OSM_BYTES) -> DataFrame:
    """Nodes, ways and relations. One job follows the headers of each file's blobs, then tasks read ranges of whole blobs.

    Files of a file system that Arrow does not know are read whole, a file per task.
    """
    listed = [(r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]  # a row per file
    try:
        file_system(listed[0][0])
    except ValueError:
        return parsed(spark, path, parse_osm, _OSM)

    most = paced(sum(n for _, n in listed), most, spark.sparkContext.defaultParallelism)

    def extents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame["file"]:
                store, at = file_system(file)
                with store.open_input_file(at) as f:
                    found = list(osm_extents(f, most))
                yield pd.DataFrame({"file": file, "low": [a for a, _ in found], "high": [b for _, b in found]})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, at = file_system(r["file"])
                with store.open_input_file(at) as f:
                    items = parse_osm(f.read_at(r["high"] - r["low"], r["low"]))
                while some := list(itertools.islice(items, 8192)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    names = ["kind", "id", "lat", "lon", "refs", "tags"]
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string())]
    own = spark.createDataFrame([(f,) for f, _ in listed], "file string").repartition(len(listed))
    tasks = max(1, sum(-(-n // most) for _, n in listed))
    return own.mapInPandas(extents, "file string, low long, high long").repartition(tasks).mapInArrow(read, _OSM)


def osm_nodes(osm: DataFrame) -> DataFrame:
    """(id, lat, lon, num_ways): nodes with how many ways run through them."""
    from pyspark.sql import functions as F

    ways = osm.where("kind = 'way'").select(F.explode(F.array_distinct("refs")).alias("id")).groupBy("id").agg(F.count("*").alias("num_ways"))
    nodes = osm.where("kind = 'node'").select("id", "lat", "lon")
    return nodes.join(ways, "id", "left").withColumn("num_ways", F.coalesce("num_ways", F.lit(0)))


# Sound


def parse_wave(data: bytes, windows: int = 100, low: float = 200.0, high: float = 2000.0) -> Iterator[tuple]:
    """(channel, window, rms, low, middle, high) of a 16-bit sound: shares of the spectrum's energy in three bands."""
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit samples")
        rate, samples = w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels())
    width = max(1, math.ceil(len(samples) / windows))
    for channel in range(samples.shape[1]):
        for k, s in enumerate(range(0, len(samples), width)):
            v = samples[s : s + width, channel].astype(float)
            power = np.abs(np.fft.rfft(v)) ** 2
            hertz = np.fft.rfftfreq(len(v), 1 / rate)
            whole = power.sum()
            bands = [power[hertz < low].sum(), power[(hertz >= low) & (hertz <= high)].sum(), power[hertz > high].sum()]
            yield (channel, k, float(np.sqrt(np.mean(v * v))), *[float(b / whole) if whole else 0.0 for b in bands])


def read_wave(spark: SparkSession, path: str, windows: int = 100, low: float = 200.0, high: float = 2000.0) -> DataFrame:
    return parsed(spark, path, lambda data: parse_wave(data, windows, low, high), "channel int, window int, rms double, low double, middle double, high double")
