"""Windows over ordered rows: neighbours, running distances, trips, offsets and chains."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.links import follow


def neighbours(df: DataFrame, within: Sequence[str], by: Sequence[str], column: str) -> DataFrame:
    """The column's value in the row before and after, per group."""
    w = Window.partitionBy(*within).orderBy(*by)
    return df.withColumns({"previous": F.lag(column).over(w), "next": F.lead(column).over(w)})


def running_distance(df: DataFrame, within: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Adds step and along: the distance from the point before, and from the first."""
    w = Window.partitionBy(*within).orderBy(*by)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    return df.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("along", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def split_trips(df: DataFrame, vehicle: str, by: Sequence[str], distance: str) -> DataFrame:
    """Adds trip, from 0 per vehicle: a new one begins where the distance falls."""
    w = Window.partitionBy(vehicle).orderBy(*by)
    fell = F.coalesce((F.col(distance) < F.lag(distance).over(w)).cast("int"), F.lit(0))
    return df.withColumn("__fell", fell).withColumn("trip", F.sum("__fell").over(w)).drop("__fell")


def trip_markers(df: DataFrame, trip: Sequence[str], by: Sequence[str], size: float = 100.0) -> DataFrame:
    """A stroke down from each point of a trip: (trip..., order columns..., seq, x, y), two rows a point."""
    ends = F.array(F.struct(F.lit(0).alias("seq"), F.col("y").cast("double").alias("y")), F.struct(F.lit(1).alias("seq"), (F.col("y") - size).alias("y")))
    own = list(dict.fromkeys([*trip, *by, "x"]))
    return df.select(*own, F.explode(ends).alias("__e")).select(*own, "__e.seq", "__e.y")


def highlight_vertices(df: DataFrame, within: Sequence[str], order: str, which: int | str = "ends", share: float = 0.1, step: float = 0.1) -> DataFrame:
    """Rings around vertices of each shape: (within..., order, seq, x, y), a vertex every ``step`` radians.

    ``which`` is a vertex's place from 0, ``all`` or ``ends`` (first and last; a lone vertex once). A ring's radius is
    ``share`` of the shape's width or height, whichever is less.
    """
    w = Window.partitionBy(*within)
    size = F.least(F.max("x").over(w) - F.min("x").over(w), F.max("y").over(w) - F.min("y").over(w)) * share
    placed = df.withColumns({"__k": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w), "__r": size})
    marked = {"all": F.lit(True), "ends": (F.col("__k") == 0) | (F.col("__k") == F.col("__n") - 1)}.get(which, F.col("__k") == which)
    around = placed.where(marked).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(2 * math.pi / step) - 1))))
    turn = F.col("seq") * step
    return around.select(*within, order, "seq", (F.col("x") + F.cos(turn) * F.col("__r")).alias("x"), (F.col("y") + F.sin(turn) * F.col("__r")).alias("y"))


def offset_lines(df: DataFrame, within: Sequence[str], by: Sequence[str], half_width: float | Column) -> DataFrame:
    """Left and right of each vertex of a line, across the direction to the next one (the last keeps its last angle).

    ``half_width`` may be a column, such as ``scalars.road_width`` of a street's name.
    """
    w = Window.partitionBy(*within).orderBy(*by)
    ahead = F.atan2(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x"))
    angled = df.withColumn("__a", ahead).withColumn("angle", F.coalesce("__a", F.last("__a", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    across = F.col("angle") + F.pi() / 2
    dx, dy = half_width * F.cos(across), half_width * F.sin(across)
    return angled.drop("__a").withColumns({"left_x": F.col("x") + dx, "left_y": F.col("y") + dy, "right_x": F.col("x") - dx, "right_y": F.col("y") - dy})


def signed_area(df: DataFrame, within: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Half the cross products of consecutive vertices: positive if counter-clockwise. The ring is not closed."""
    w = Window.partitionBy(*within).orderBy(*by)
    cross = F.col("x") * F.lead("y").over(w) - F.lead("x").over(w) * F.col("y")
    return df.withColumn("__c", cross).groupBy(*within).agg((F.sum("__c") / 2).alias("area"))


def orient(df: DataFrame, within: Sequence[str], order: str, direction: str) -> DataFrame:
    """Renumbers the vertices of rings so that none runs against ``direction`` (``cw``: clockwise ones are turned,
    ``ccw``: counter-clockwise ones, ``reverse``: all)."""
    w = Window.partitionBy(*within)
    by = w.orderBy(order)
    cross = F.col("x") * F.lead("y").over(by) - F.lead("x").over(by) * F.col("y")
    area = F.sum("__c").over(w)
    turned = {"cw": area < 0, "ccw": area > 0, "reverse": F.lit(True)}[direction]
    low, high = F.min(order).over(w), F.max(order).over(w)
    return df.withColumn("__c", cross).withColumn(order, F.when(turned, low + high - F.col(order)).otherwise(F.col(order))).drop("__c")


def chain_segments(segments: DataFrame, start: DataFrame) -> DataFrame:
    """Follows (street, from_node, to_node, length) forwards from each street's start node, then backwards from it.

    Where a node has several segments the one to the smaller node goes on. A node is visited once: the way forward ends
    at a node that it has passed, the way back at one that either has. Returns (street, node, step, along); step and
    along are 0 at the start and negative before it. Streets of any length take a logarithmic number of joins.
    """
    links = lambda a, b, way: segments.groupBy("street", F.col(a).alias("node")).agg(F.min(F.struct(F.col(b).alias("next"), "length")).alias("s")).select(F.lit(way).alias("way"), "street", "node", "s.next", "s.length")
    both = links("from_node", "to_node", 1).union(links("to_node", "from_node", -1))
    starts = start.select("street", "node", F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"))
    found = follow(both, starts, ["way", "street"])
    ahead, back = found.where("way = 1"), found.where("way = -1 and step > 0")
    met = back.join(ahead.select("street", "node"), ["street", "node"]).groupBy("street").agg(F.min("step").alias("met"))
    rest = back.join(met, "street", "left").where("met is null or step < met")
    return ahead.select("street", "node", "step", "along").union(rest.select("street", "node", -F.col("step"), -F.col("along")))
