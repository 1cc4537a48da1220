"""Columns of shapes: coordinates, colours and ids, added where a table lacks them and read where they have other names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A coordinate's own name and the one it may have instead.
NAMES = {"x": "lon", "y": "lat", "z": "z"}
SHAPE = ("shape_row_id", "shape_part_id", "shape_part_type")


def _added(df: DataFrame, names: tuple[str, ...], kind: str, value: float = 0) -> DataFrame:
    return df.withColumns({n: F.lit(value).cast(kind) for n in names if n not in df.columns})


def add_shape_columns(df: DataFrame) -> DataFrame:
    """shape_row_id, shape_part_id and shape_part_type, 0 where they are new; columns that are there stay."""
    return _added(df, SHAPE, "int")


def add_xy(df: DataFrame, z: bool = False) -> DataFrame:
    return _added(df, ("x", "y", "z") if z else ("x", "y"), "double")


def add_rgb(df: DataFrame, alpha: bool = False) -> DataFrame:
    """Black, and opaque with ``alpha``."""
    with_colour = _added(df, ("red", "green", "blue"), "double")
    return _added(with_colour, ("alpha",), "double", 1) if alpha else with_colour


def coordinate(df: DataFrame, name: str) -> Column:
    """x, y or z of a row under either of its names, as a double; 0 where the table has neither or the value is missing."""
    found = next((c for c in (name, NAMES[name]) if c in df.columns), None)
    return F.coalesce(F.col(found).cast("double"), F.lit(0.0)) if found else F.lit(0.0)


def set_columns(df: DataFrame, **values: Column | float) -> DataFrame:
    """Sets x, y, z, red ... under the name that the table has for them; a column that is new is added."""
    named = {next((c for c in (k, NAMES.get(k, k)) if c in df.columns), k): v for k, v in values.items()}
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in named.items()})


def blank(df: DataFrame, *names: str) -> DataFrame:
    """Columns emptied: 0 for numbers, "" for texts, by their type."""
    empty = lambda c: F.lit("") if isinstance(df.schema[c].dataType, T.StringType) else F.lit(0).cast(df.schema[c].dataType)
    return df.withColumns({c: empty(c) for c in names})


def text_width(df: DataFrame, name: str) -> DataFrame:
    """(width): the most characters of a text column, 0 where there are none."""
    return df.agg(F.coalesce(F.max(F.length(name)), F.lit(0)).alias("width"))
