"""Row selection, set operations, order and first-wins de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-6


def filter_equal(df: DataFrame, column: str, values: Sequence, keep: bool = True) -> DataFrame:
    """Rows whose column is one of ``values`` (or none of them); decimals match within a millionth. Nulls never match."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        hit = F.lit(False)
        for v in values:
            hit |= F.abs(c - float(v)) < EPSILON
    else:
        hit = c.isin(*values)
    return df.where(hit if keep else ~F.coalesce(hit, F.lit(False)))


def filter_bbox(df: DataFrame, min_x: float, max_x: float, min_y: float, max_y: float, x: str = "x", y: str = "y", strict: bool = False) -> DataFrame:
    """Points in a rectangle, edges included unless ``strict``."""
    if strict:
        return df.where((F.col(x) > min_x) & (F.col(x) < max_x) & (F.col(y) > min_y) & (F.col(y) < max_y))
    return df.where(F.col(x).between(min_x, max_x) & F.col(y).between(min_y, max_y))


def filter_bbox_of(df: DataFrame, other: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points strictly inside the bounds of another layer, joined as one aggregated row."""
    box = other.agg(F.min(x).alias("__a"), F.max(x).alias("__b"), F.min(y).alias("__c"), F.max(y).alias("__d"))
    inside = (F.col(x) > F.col("__a")) & (F.col(x) < F.col("__b")) & (F.col(y) > F.col("__c")) & (F.col(y) < F.col("__d"))
    return df.join(F.broadcast(box), inside, "left_semi")


def filter_any_positive(df: DataFrame, *columns: str) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit |= F.col(c) > 0
    return df.where(hit)


def thin(points: Column, distance: float, euclid: bool = False, tall: float | None = None) -> Column:
    """Of an ordered array of structs with x and y, those not near the last one kept (greedy, the first stays).

    Near is less than ``distance`` in x and ``tall`` (by default ``distance``) in y, or than ``distance`` in the plane with
    ``euclid``. Axes of different scales have their own limits: coordinates that were scaled round to the wrong side.
    """
    tall = distance if tall is None else tall

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        dx, dy = p["x"] - last["x"], p["y"] - last["y"]
        near = (dx * dx + dy * dy < distance * distance) if euclid else (F.abs(dx) < distance) & (F.abs(dy) < tall)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(p)))

    return F.when(F.size(points) > 0, F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1), step)).otherwise(points)


def unique_first(df: DataFrame, column: str, order: Sequence[str | Column], last: bool = False) -> DataFrame:
    """The first row of each value (or the last), by an explicit order.

    One aggregation with partial results: a task sends one row per value, which travels as a struct. Spark sorts by
    the value for it (a struct is no fixed-width buffer), but never a group by its order, and no group is held whole.
    """
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]))
    return df.groupBy(F.col(column).alias("__key")).agg(row.alias("__row")).select("__row.*")


def sort_rows(df: DataFrame, column: str, tie: Sequence[str], descending: bool = False) -> DataFrame:
    """Stable by ``tie``."""
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc(), *tie)


def top(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def append(*tables: DataFrame) -> DataFrame:
    """All rows, by position: types must agree, names are the first table's. A mismatch is an error."""
    first = tables[0]
    out = first
    for t in tables[1:]:
        if [f.dataType for f in t.schema] != [f.dataType for f in first.schema]:
            raise ValueError(f"columns differ: {first.dtypes} and {t.dtypes}")
        out = out.union(t.toDF(*first.columns))
    return out


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return append(a, b).distinct()


def without(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key the other table lacks."""
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def insert_rows(df: DataFrame, rows: DataFrame, at: int, order: str = "__row") -> DataFrame:
    """Rows put before the row numbered ``at``, the later ones renumbered."""
    from millrace.table import number_in_order

    n = rows.count()
    moved = df.withColumn(order, F.when(F.col(order) >= at, F.col(order) + n).otherwise(F.col(order)))
    numbered = number_in_order(rows, order, name="__place")
    return moved.unionByName(numbered.withColumn(order, (F.col("__place") - 1 + at).cast("long")).drop("__place"))
