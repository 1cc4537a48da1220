"""Writers. Rows become text on the executors; a file that must be one file is joined from the parts of its tasks."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalars as S
from millrace.sources.single import join_parts, write_lines


def _cell(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return F.coalesce(S.as_text(c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.cast("string"), F.lit(""))


def csv_lines(df: DataFrame, quotes: bool = True) -> DataFrame:
    """Each row as text: decimals with six places; values with a comma, quote or line break are quoted."""
    cells = []
    for f in df.schema:
        v = _cell(f)
        cells.append(F.when(v.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v) if quotes else v)
    return df.select(F.concat_ws(",", *cells).alias("value"))


def write_csv(df: DataFrame, path: str, header: bool = True, quotes: bool = True, crlf: bool = False, order: Sequence[str] = ()) -> None:
    """One CSV file, in ``order``."""
    names = ",".join(f'"{n}"' if quotes else n for n in df.columns)
    write_lines(csv_lines(df.orderBy(*order) if order else df, quotes), path, "\r\n" if crlf else "\n", [names] if header else [])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in as many files as there are partitions."""
    df.write.mode("overwrite").json(path)


def _number(c: Column) -> Column:
    return S.as_text(c)


def shape_rows(df: DataFrame, name: str | None = None, order: str = "seq") -> DataFrame:
    """(shape_row_id, name, parts): parts as JSON text of points with six decimals, shape by shape on the executors."""
    point = F.concat(F.lit("["), _number(F.col("x")), F.lit(","), _number(F.col("y")), F.lit("]"))
    parts = df.groupBy("shape_row_id", "shape_part_id").agg(F.array_sort(F.collect_list(F.struct(order, point.alias("p")))).alias("v"), F.first(name or F.lit("")).alias("name"))
    text = F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: x["p"]), ","), F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct("shape_part_id", text.alias("t"))))
    return parts.groupBy("shape_row_id").agg(F.first("name").alias("name"), F.transform(rows, lambda x: x["t"]).alias("parts"))


def write_js(df: DataFrame, path: str, variable: str, attrs: Sequence[tuple[str, object]] = (), shapes: bool = False, name: str | None = None, order: str = "seq") -> None:
    """``var name = {...};`` with attributes, columns, and rows or shapes: valid JSON after the assignment."""
    kinds = {"int": "int32", "bigint": "int64", "string": "char"}
    head = [f"var {variable} = {{", '"blocks": [{', f'"attributes": {json.dumps([list(a) for a in attrs])},', f'"columns": {json.dumps([[n, kinds.get(t, t)] for n, t in df.dtypes])},']
    bare = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    if shapes:
        own = shape_rows(df, name, order).orderBy("shape_row_id")
        row = F.concat(F.lit('{"name": '), bare(F.col("name")), F.lit(', "parts": ['), F.array_join("parts", ","), F.lit("]}"))
    else:
        own, row = df, F.concat(F.lit("["), F.concat_ws(",", *[bare(F.col(f"`{f.name}`")) for f in df.schema]), F.lit("]"))
    rows = own.select(F.concat(F.lit(","), row).alias("value"))  # the first comma is skipped
    write_lines(rows, path, before=[*head, f'"{"shapes" if shapes else "rows"}": ['], after=["]", "}]", "};"], skip=1)


def kml_marks(df: DataFrame, name: str | None = None, order: str = "seq") -> DataFrame:
    """(shape_row_id, value): a Placemark per shape, its first part the outer ring and the others inner ones."""
    line = F.concat(_number(F.col("x")), F.lit(","), _number(F.col("y")), F.lit(",50"))
    has = set(df.columns)
    colour = S.hex_colour(*[F.col(c) if c in has else F.lit(1.0) for c in ("red", "green", "blue")], F.col("alpha") * 0.5 if "alpha" in has else F.lit(100 / 255))
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = df.groupBy("shape_row_id", "shape_part_id").agg(
        F.array_sort(F.collect_list(F.struct(order, line.alias("p"), colour.alias("c")))).alias("v"), F.first(F.col(name).cast("string") if name else F.lit("")).alias("name")
    )
    ring = F.concat(F.lit("<LinearRing><coordinates>\n"), F.array_join(F.transform("v", lambda x: x["p"]), "\n"), F.lit("\n</coordinates></LinearRing>"))
    shapes = parts.groupBy("shape_row_id").agg(F.array_sort(F.collect_list(F.struct("shape_part_id", ring.alias("r"), F.col("v")[0]["c"].alias("c")))).alias("p"), F.first("name").alias("name"))
    boundary = F.array_join(F.transform("p", lambda x, i: F.concat(F.when(i == 0, "<outerBoundaryIs>").otherwise("<innerBoundaryIs>"), x["r"], F.when(i == 0, "</outerBoundaryIs>").otherwise("</innerBoundaryIs>"))), "\n")
    style = F.concat(F.lit("<Style><PolyStyle><color>"), F.col("p")[0]["c"], F.lit("</color><colorMode>normal</colorMode><outline>0</outline></PolyStyle></Style>\n"))
    title = F.concat(F.lit("<name>"), escape(F.col("name")), F.lit("</name>\n")) if name else F.lit("")
    body = F.concat(F.lit("<Placemark>\n"), title, style, F.lit("<Polygon><extrude>1</extrude><altitudeMode>relativeToGround</altitudeMode>\n"), boundary, F.lit("\n</Polygon>\n</Placemark>"))
    return shapes.select("shape_row_id", body.alias("value"))


def write_kml(df: DataFrame, path: str, name: str | None = None, order: str = "seq") -> None:
    marks = kml_marks(df, name, order).orderBy("shape_row_id")
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<kml xmlns="http://www.opengis.net/kml/2.2">', "<Document>"]
    write_lines(marks.select("value"), path, before=head, after=["</Document>", "</kml>"])


def _sql_type(f: T.StructField) -> str:
    return "varchar(255)" if isinstance(f.dataType, T.StringType) else "double" if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else "bigint" if isinstance(f.dataType, T.LongType) else "int"


def sql_statements(df: DataFrame, table: str, drop: bool = False, created_at: bool = False, batch: int = 100) -> tuple[list[str], DataFrame]:
    """The statements that make the table, and a DataFrame of inserts of up to ``batch`` rows, built per partition."""
    columns = "".join(f", `{f.name}` {_sql_type(f)}" for f in df.schema)
    make = [f"DROP TABLE IF EXISTS `{table}`;"] * drop + [f"CREATE TABLE IF NOT EXISTS `{table}` (id int PRIMARY KEY AUTO_INCREMENT{', `created_at` datetime' * created_at}{columns});"]
    cells = []
    for f in df.schema:
        v = _cell(f)
        if isinstance(f.dataType, T.StringType):
            v = F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        cells.append(F.when(F.col(f"`{f.name}`").isNull(), "NULL").otherwise(v))
    names = ("`created_at`," * created_at) + ",".join(f"`{c}`" for c in df.columns)
    row = F.concat(F.lit("(" + "NOW()," * created_at), F.concat_ws(",", *cells), F.lit(")"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            for lo in range(0, len(frame), batch):
                yield pd.DataFrame({"value": [f"INSERT INTO `{table}` ({names}) VALUES {','.join(frame['value'][lo : lo + batch])};"]})

    return make, df.select(row.alias("value")).mapInPandas(run, "value string")


def table_changes(df: DataFrame, table: str, known: Mapping[str, str]) -> list[str]:
    """The statements that let a table of ``known`` columns (name to type) take the rows of ``df``.

    A column it lacks is added; one of whole numbers or decimals that is given text, or whole numbers given decimals,
    is widened. Nothing is dropped or made narrower.
    """
    rank = {"int": 0, "bigint": 1, "double": 2, "varchar(255)": 3}
    out = []
    for f in df.schema:
        kind = _sql_type(f)
        if f.name not in known:
            out.append(f"ALTER TABLE `{table}` ADD COLUMN `{f.name}` {kind};")
        elif rank[kind] > rank.get(known[f.name], 3):
            out.append(f"ALTER TABLE `{table}` MODIFY COLUMN `{f.name}` {kind};")
    return out


def append_evolving(df: DataFrame, path: str) -> DataFrame:
    """Appends to a folder of Parquet whose schema may grow, and returns it whole; columns a part lacks are null."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.option("mergeSchema", True).parquet(path)


def write_sql(df: DataFrame, path: str, table: str, drop: bool = False, created_at: bool = False) -> None:
    make, inserts = sql_statements(df, table, drop, created_at)
    write_lines(inserts, path, before=make)


def _filled(placed: DataFrame, order: str) -> DataFrame:
    """(__x, __y, shape_row_id, colours) of the pixels inside triangles, three vertices of a part each, line by line."""
    colours = [c for c in ("red", "green", "blue") if c in placed.columns]
    corners = F.array_sort(F.collect_list(F.struct(order, "__x", "__y"))).alias("p")
    parts = placed.groupBy("shape_row_id", "shape_part_id").agg(corners, *[F.first(c).alias(c) for c in colours]).where("size(p) >= 3")
    x = [F.col("p")[k]["__x"] for k in range(3)]
    y = [F.col("p")[k]["__y"] for k in range(3)]
    lines = parts.withColumn("__y", F.explode(F.sequence(F.ceil(F.least(*y)).cast("int"), F.greatest(F.ceil(F.least(*y)), F.floor(F.greatest(*y))).cast("int"))))
    row = F.col("__y")
    cuts = []
    for a, b in ((0, 1), (1, 2), (2, 0)):  # where each edge crosses the line of pixels
        low, high = F.least(y[a], y[b]), F.greatest(y[a], y[b])
        cuts.append(F.when((row >= low) & (row <= high) & (high > low), x[a] + (row - y[a]) / (y[b] - y[a]) * (x[b] - x[a])))
    left, right = F.least(*cuts), F.greatest(*cuts)
    spans = lines.withColumns({"__l": F.round(left).cast("int"), "__r": F.round(right).cast("int")}).where("__l is not null")
    return spans.select("shape_row_id", *colours, row.cast("double").alias("__y"), F.explode(F.transform(F.sequence("__l", "__r"), lambda v: v.cast("double"))).alias("__x"))


def pixels(
    df: DataFrame, width: int = 1000, margin: float = 0.01, order: str = "seq", fill: bool = False, point_size: int = 1, rotation: float = 0.0, zoom: float = 1.0
) -> tuple[DataFrame, int, int]:
    """(px, py, red, green, blue) of the drawn parts, and the picture's width and height.

    Height follows the data's bounds, at most 1.5 times the width. A part is drawn by its ``shape_part_type``: 4 a filled
    triangle, 7 a closed line, 5 a line, any other points, squares of ``point_size`` pixels; without that column all
    parts are lines, and with ``fill`` triangles. ``zoom`` enlarges about the middle, ``rotation`` (degrees) tilts the
    picture about its horizontal axis, with z where there is one. Lines are stepped pixel by pixel on the executors; the
    last shape wins a pixel, and what falls outside the picture is left out.
    """
    b = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    wide, tall = max(b[1] - b[0], 1e-12), max(b[3] - b[2], 1e-12)
    height = max(1, int(min(width * tall / wide, 1.5 * width)))
    at = lambda c, low, span, size: (margin + (1 - 2 * margin) * (F.col(c) - low) / span) * (size - 1)
    from pyspark.sql import Window

    turn, mx, my = math.radians(rotation), (width - 1) / 2, (height - 1) / 2
    depth = F.col("z") / tall * (1 - 2 * margin) * (height - 1) if "z" in df.columns else F.lit(0.0)
    x, y = at("x", b[0], wide, width), at("y", b[2], tall, height)
    if zoom != 1 or rotation:
        x, y = mx + zoom * (x - mx), my + zoom * ((y - my) * math.cos(turn) - depth * math.sin(turn))
    kind = F.col("shape_part_type") if "shape_part_type" in df.columns else F.lit(4 if fill else 5)
    w = Window.partitionBy("shape_row_id", "shape_part_id").orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = df.withColumns({"__x": x, "__y": (height - 1) - y, "__kind": F.coalesce(kind.cast("int"), F.lit(0))})
    closed, dots = F.col("__kind").isin(4, 7), ~F.col("__kind").isin(4, 5, 7)
    following = lambda c: F.when(dots, F.col(c)).otherwise(F.coalesce(F.lead(c).over(w), F.when(closed, F.first(c).over(whole)), F.col(c)))
    ahead = placed.withColumns({"__nx": following("__x"), "__ny": following("__y")})
    steps = F.ceil(F.greatest(F.abs(F.col("__nx") - F.col("__x")), F.abs(F.col("__ny") - F.col("__y")), F.lit(1))).cast("int")
    drawn = ahead.withColumn("__n", F.when(dots, 0).otherwise(steps)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    share = F.coalesce(F.try_divide("__k", "__n"), F.lit(0.0))
    colour = [F.col(c) if c in df.columns else F.lit(0.0) for c in ("red", "green", "blue")]
    spot = drawn.select(F.round(F.col("__x") + share * (F.col("__nx") - F.col("__x"))).cast("int").alias("px"), F.round(F.col("__y") + share * (F.col("__ny") - F.col("__y"))).cast("int").alias("py"), F.struct("shape_row_id", *[c.alias(n) for c, n in zip(colour, "rgb")]).alias("s"), dots.alias("dot"))
    if point_size > 1:
        offsets = F.sequence(F.lit(-((point_size - 1) // 2)), F.lit(point_size // 2))
        one = F.array(F.lit(0))
        spot = spot.select("px", "py", "s", "dot", F.explode(F.when(F.col("dot"), offsets).otherwise(one)).alias("dx")).select("py", "s", "dot", (F.col("px") + F.col("dx")).alias("px"), F.explode(F.when(F.col("dot"), offsets).otherwise(one)).alias("dy")).select("px", (F.col("py") + F.col("dy")).alias("py"), "s")
    spot = spot.select("px", "py", "s")
    if fill or "shape_part_type" in df.columns:
        spot = spot.union(_filled(placed.where("__kind = 4"), order).select(F.col("__x").cast("int"), F.col("__y").cast("int"), F.struct("shape_row_id", *[c.alias(n) for c, n in zip(colour, "rgb")])))
    top = spot.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)).groupBy("px", "py").agg(F.max("s").alias("s"))
    return top.select("px", "py", F.col("s.r").alias("red"), F.col("s.g").alias("green"), F.col("s.b").alias("blue")), width, height


def encode_png(image: np.ndarray) -> bytes:
    """A PNG of an array (height, width, 3) of bytes."""
    h, w, _ = image.shape
    raw = b"".join(b"\0" + row.tobytes() for row in image)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_png(df: DataFrame, path: str, width: int = 1000, order: str = "seq", fill: bool = False, point_size: int = 1, rotation: float = 0.0, zoom: float = 1.0) -> None:
    """The picture has a bounded number of pixels, which is all that reaches the driver."""
    found, w, h = pixels(df, width, order=order, fill=fill, point_size=point_size, rotation=rotation, zoom=zoom)
    image = np.full((h, w, 3), 255, dtype=np.uint8)
    for r in found.toLocalIterator():
        image[r["py"], r["px"]] = [int(255 * max(0.0, min(1.0, r[c]))) for c in ("red", "green", "blue")]
    join_parts(df.sparkSession, path, [encode_png(image)])
