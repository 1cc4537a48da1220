"""Pipelines as text: ``python -m millrace.cli 'read t.parquet | filter --column=a --values=1,2 | unique --column=b --order=c | csv out.csv'``.

Each step is an operator with options; a pipeline is one lazy plan until its last step writes.
"""

from __future__ import annotations

import shlex
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalars
from millrace.operators import aggregates, columns, joins, rows, sequences, shapes
from millrace.sources import blockfile, delimited, files, generate, shapefile, writers


def parse(text: str) -> list[tuple[str, list[str], dict[str, str]]]:
    """Steps as (name, arguments, options)."""
    steps, now = [], []
    for word in [*shlex.split(text.replace("|", " | ")), "|"]:
        if word != "|":
            now.append(word)
        elif now:
            options = dict((w[2:].split("=", 1) + ["true"])[:2] for w in now[1:] if w.startswith("--"))
            steps.append((now[0], [w for w in now[1:] if not w.startswith("--")], options))
            now = []
    return steps


def _list(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def _keys(options: dict[str, str]) -> list[str]:
    """The columns of a part."""
    return _list(options.get("within", "shape_row_id,shape_part_id"))


def _ring(text: str) -> list[tuple[float, float]]:
    """``x,y,x,y,...`` as vertices."""
    v = [float(x) for x in _list(text)]
    return list(zip(v[::2], v[1::2]))


def _values(df: DataFrame, column: str, text: str) -> list:
    kind = df.schema[column].dataType
    cast = int if isinstance(kind, T.IntegralType) else float if isinstance(kind, T.FractionalType) else str
    return [cast(v) for v in _list(text)]


def _read(spark: SparkSession, path: str) -> DataFrame:
    """By the file name's ending."""
    readers = {
        "parquet": lambda: spark.read.parquet(path), "json": lambda: spark.read.json(path), "csv": lambda: delimited.read_delimited(spark, path), "b": lambda: blockfile.read_blocks(spark, path),
        "shp": lambda: shapefile.read_shapefile(spark, path), "dbf": lambda: shapefile.read_shapefile(spark, path), "svg": lambda: files.read_svg(spark, path), "kml": lambda: files.read_kml(spark, path),
        "dem": lambda: files.read_dem(spark, path), "pbf": lambda: files.read_osm(spark, path), "wav": lambda: files.read_wave(spark, path),
    }
    return readers[path.rsplit(".", 1)[-1]]()


def _triangles(df: DataFrame, shape: str, part: str, order: str) -> DataFrame:
    """A shape's triangles as its parts (shape_part_type 4), with the other columns of its first row."""
    found = shapes.tessellate(df, shape, part, order).withColumnsRenamed({"triangle": part, "corner": order})
    rest = [c for c in df.columns if c not in (shape, part, order, "x", "y", "shape_part_type")]
    typed = found.withColumn("shape_part_type", F.lit(4))
    if not rest:
        return typed
    first = df.groupBy(F.col(shape).alias("__shape")).agg(F.min_by(F.struct(*rest), F.struct(part, order)).alias("__rest"))
    return typed.join(first, F.col(shape).eqNullSafe(F.col("__shape")), "left").select(*typed.columns, *[F.col(f"__rest.{c}").alias(c) for c in rest])


SOURCES = {
    "read": lambda spark, a, o: _read(spark, a[0]),
    "generate": lambda spark, a, o: generate.square(spark) if o.get("shape") == "square" else generate.circle(spark, int(o.get("n", "50"))),
    "sql": lambda spark, a, o: spark.sql(a[0]),
}
STEPS = {
    "filter": lambda df, a, o: rows.filter_equal(df, o["column"], _values(df, o["column"], o["values"]), o.get("option", "pass").lower() != "delete"),
    "bbox": lambda df, a, o: rows.filter_bbox(df, *[float(v) for v in _list(o["bbox"])]),
    "unique": lambda df, a, o: rows.unique_first(df, o["column"], _list(o["order"])),
    "sort": lambda df, a, o: rows.sort_rows(df, o["column"], _list(o.get("tie", "")), "descending" in o),
    "limit": lambda df, a, o: df.limit(int(a[0])),
    "columns": lambda df, a, o: columns.edit_columns(df, *[_list(o.get(k, "")) for k in ("remove", "makeint", "makeintfromtime", "makefloat")]),
    "strcat": lambda df, a, o: columns.concat_text(df, _list(o["columns"]), o["name"]),
    "trim": lambda df, a, o: columns.trim_spaces(df, *_list(o["columns"])),
    "multiply": lambda df, a, o: columns.multiply(df, o["column"], float(o["by"])),
    "offset": lambda df, a, o: columns.offset(df, o["column"], float(o["by"])),
    "normalize": lambda df, a, o: columns.normalize(df, _list(o["columns"])),
    "join": lambda df, a, o: joins.join_tables(df, _read(df.sparkSession, o["file"]), o["left"], o["right"], o.get("join", "left")),
    "append": lambda df, a, o: rows.append(df, *[_read(df.sparkSession, p) for p in a]),
    "inspect": lambda df, a, o: aggregates.value_counts(df, o["column"]),
    "bounds": lambda df, a, o: aggregates.bounds_report(df),
    "dump": lambda df, a, o: aggregates.first_and_last(df, _list(o["order"]), int(o.get("n", "26"))),
    "bbox-polygon": lambda df, a, o: aggregates.bbox_polygon(df, _list(o.get("by", "")), float(o.get("border", "0"))),
    "rescale": lambda df, a, o: columns.rescale_bounds(df, *[float(v) for v in _list(o["bbox"])]),
    "color": lambda df, a, o: columns.colour_by_rules(df, _read(df.sparkSession, o["file"]), o["column"], o.get("order", "rule")),
    "random-color": lambda df, a, o: columns.random_colours(df, int(o.get("seed", "0")), _list(o.get("within", ""))),
    "grayscale": lambda df, a, o: columns.grayscale(df),
    "wday": lambda df, a, o: df.withColumn("wday", scalars.weekday(F.col(o["column"]), o.get("first", "sunday"))),
    "is-opp": lambda df, a, o: df.withColumn("is_opp", aggregates.is_opposite(F.col(o.get("column", "location1")))),
    "reset-ids": lambda df, a, o: columns.renumber(df, o["column"]),
    "thin": lambda df, a, o: shapes.thin_parts(df, _keys(o), o.get("order", "seq"), float(o["distance"]), "euclid" in o),
    "loop-overlap": lambda df, a, o: shapes.cut_overlap(df, _keys(o), o.get("order", "seq"), float(o.get("distance", "1e-6"))),
    "simplify": lambda df, a, o: shapes.simplify(df, _keys(o), o.get("order", "seq"), float(o.get("distance", "0.0001"))),
    "tesselate": lambda df, a, o: _triangles(df, o.get("shape", "shape_row_id"), o.get("part", "shape_part_id"), o.get("order", "seq")),
    "clip": lambda df, a, o: shapes.clip(df, o.get("shape", "shape_row_id"), o.get("order", "seq"), _ring(o["ring"]), o.get("operation", "intersection")).drop("operation", "__clip"),
    "winding": lambda df, a, o: sequences.orient(df, _keys(o), o.get("order", "seq"), o.get("direction", "ccw")),
    "offset-lines": lambda df, a, o: sequences.offset_lines(df, _keys(o), [o.get("order", "seq")], float(o["width"])),
    "along": lambda df, a, o: sequences.running_distance(df, _keys(o), [o.get("order", "seq")]),
    "highlight": lambda df, a, o: sequences.highlight_vertices(df, _keys(o), o.get("order", "seq"), int(o["i"]) if "i" in o else "all" if "all" in o else "ends"),
    "polygons": lambda df, a, o: joins.point_in_triangle(df, _read(df.sparkSession, o["file"]), o.get("order", "polygon_id"), float(o["cell"]), "last" in o, o.get("id")),
    "nearest": lambda df, a, o: joins.nearest(df, df, o["id"], o["id"], float(o["cell"]), same_layer=True),
    "move-to-street": lambda df, a, o: joins.move_to_street(df, _read(df.sparkSession, o["file"]), o["id"], float(o["reach"]), float(o["cell"]), o.get("prefer")),
    "snap": lambda df, a, o: joins.snap_to_segments(df, _read(df.sparkSession, o["file"]), o["id"], float(o["reach"]), float(o["cell"]), o.get("prefer")),
    "rms": lambda df, a, o: aggregates.rms(df, o["key"], o.get("order", "seq"), o["value"], int(o["width"])),
    "fft": lambda df, a, o: spectra.magnitudes(df, o["key"], o.get("order", "seq"), o["value"], "inverse" in o),
    "select": lambda df, a, o: df.select(*[F.expr(x) for x in a]),
    "where": lambda df, a, o: df.where(" ".join(a)),
    "pass": lambda df, a, o: df,
}
SINKS = {
    "csv": lambda df, a, o: writers.write_csv(df, a[0], "no-header" not in o, "no-quotes" not in o, "crlf" in o, _list(o.get("order", ""))),
    "js": lambda df, a, o: writers.write_js(df, a[0], o.get("variable", "data"), shapes="shapes" in o),
    "json": lambda df, a, o: writers.write_json(df, a[0]),
    "kml": lambda df, a, o: writers.write_kml(df, a[0], o.get("name")),
    "mysql": lambda df, a, o: writers.write_sql(df, a[0], o["table"], "drop" in o),
    "shapefile": lambda df, a, o: shapefile.write_shapefile(df, a[0], _list(o.get("attributes", ""))),
    "png": lambda df, a, o: writers.write_png(df, a[0], int(o.get("width", "1000")), o.get("order", "seq"), "fill" in o, int(o.get("pointsize", "1")), float(o.get("rotation", "0")), float(o.get("zoom", "1"))),
    "block": lambda df, a, o: (df.sparkSession.dataSource.register(blockfile.BlockDataSource), df.write.format("block").mode("append").save(a[0])),
    "parquet": lambda df, a, o: df.write.mode("overwrite").parquet(a[0]),
    "show": lambda df, a, o: df.show(int(a[0]) if a else 20, truncate=False),
}


def run(spark: SparkSession, text: str) -> DataFrame | None:
    """The last step's table, or None if it was written."""
    df: DataFrame | None = None
    for name, args, options in parse(text):
        if name in SOURCES:
            df = SOURCES[name](spark, args, options)
        elif df is None:
            raise ValueError(f"{name} has no input")
        elif name in STEPS:
            df = STEPS[name](df, args, options)
        elif name in SINKS:
            SINKS[name](df, args, options)
            return None
        else:
            raise ValueError(f"no such step: {name}")
    return df


def main() -> None:
    from millrace.plans.session import session

    found = run(session(), sys.argv[1])
    if found is not None:
        found.show(truncate=False)


if __name__ == "__main__":
    main()
