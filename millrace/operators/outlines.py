"""Outlines of shapes from their edges: shared edges cancel in one aggregation, what is left is stitched by list ranking.

An edge is a row; no shape is ever one group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import links, scans
from millrace.plans.session import stored

ENDS = ("px", "py", "qx", "qy")


def same(left: str, right: str, names: Sequence[str]) -> Column:
    """Null-safe equality of columns of two aliased tables."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names], F.lit(True))


def ring_edges(df: DataFrame, keys: Sequence[str], order: str, digits: int | None = 6, place: str | None = None) -> DataFrame:
    """(keys..., px, py, qx, qy): the edges of closed rings, each ring counter-clockwise, its coordinates rounded.

    ``place`` names a column of numbers that grow along each ring.

    Vertices without a coordinate are left out; a closing vertex and repeated ones give no edge, nor do rings without
    an area.
    """
    c = F.col
    v = df.where("x is not null and y is not null").select(*keys, c(order).alias("__o"), *[((c(a).cast("double") if digits is None else F.round(c(a).cast("double"), digits)) + 0.0).alias(a) for a in ("x", "y")])
    v = stored(scans.numbered(v, ["__o"], keys, "__i"))
    first = v.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "__i").alias("f"), F.max("__i").alias("n"))
    ahead = v.select(*keys, (c("__i") - 1).alias("__i"), c("x").alias("qx"), c("y").alias("qy"))
    # the first vertex follows the last one
    closing = first.select(*keys, c("n").alias("__i"), c("f.x").alias("qx"), c("f.y").alias("qy"))
    ahead = ahead.where("__i > 0").union(closing)
    edges = v.alias("t").join(ahead.alias("u"), same("t", "u", [*keys, "__i"])).select(*[f"t.{k}" for k in keys], "t.__i", c("x").alias("px"), c("y").alias("py"), "qx", "qy").where("px <> qx or py <> qy")
    # cross products from the ring's first vertex: what is far from the origin does not lose digits
    with_first = edges.alias("t").join(first.alias("u"), same("t", "u", keys)).select("t.*", "f")
    cross = (c("px") - c("f.x")) * (c("qy") - c("f.y")) - (c("qx") - c("f.x")) * (c("py") - c("f.y"))
    area = with_first.groupBy(*keys).agg(F.sum(cross).alias("area")).where("area <> 0")
    turned = lambda a, b: F.when(c("area") > 0, c(a)).otherwise(c(b)).alias(a)
    return edges.alias("t").join(area.alias("u"), same("t", "u", keys)).select(*[f"t.{k}" for k in keys], turned("px", "qx"), turned("py", "qy"), turned("qx", "px"), turned("qy", "py"), *([F.when(c("area") > 0, c("__i")).otherwise(-c("__i")).alias(place)] if place else []))


def cancelled(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The edges that do not run both ways within their group, each once."""
    c = F.col
    forward = F.struct("px", "py") < F.struct("qx", "qy")
    ends = [F.when(forward, c(a)).otherwise(c(b)).alias(a) for a, b in zip(ENDS, ("qx", "qy", "px", "py"))]
    net = edges.select(*keys, *ends, F.when(forward, 1).otherwise(-1).alias("way")).groupBy(*keys, *ENDS).agg(F.sum("way").alias("net")).where("net <> 0")
    turned = lambda a, b: F.when(c("net") > 0, c(a)).otherwise(c(b)).alias(a)
    return net.select(*keys, turned("px", "qx"), turned("py", "qy"), turned("qx", "px"), turned("qy", "py"))


def stitch(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., part, seq, x, y): directed edges end to end as rings, outlines counter-clockwise and holes clockwise.

    Parts are numbered from 0 by their smallest vertex, which is where a ring begins. Where several edges leave a
    vertex, the one of the sharpest left turn goes on, so rings that touch stay apart. As many edges must enter a
    vertex as leave it; an edge that finds no other, as ends of crossings may that rounding put side by side, goes on
    where one begins that none has found.
    """
    c = F.col
    e = stored(scans.numbered(edges.select(*keys, *ENDS), [*keys, *ENDS], (), "id"))
    back, on = F.atan2(c("t.py") - c("t.qy"), c("t.px") - c("t.qx")), F.atan2(c("u.qy") - c("u.py"), c("u.qx") - c("u.px"))
    turn = F.pmod(back - on, F.lit(2 * 3.141592653589793))
    meets = same("t", "u", keys) & (c("t.qx") == c("u.px")) & (c("t.qy") == c("u.py"))
    ahead = stored(e.alias("t").join(e.alias("u"), meets).groupBy(c("t.id").alias("node")).agg(F.min_by("u.id", F.struct(turn, "u.id")).alias("next")))
    found = ahead.groupBy("next").agg(F.min("node").alias("node"))
    if found.count() < e.count():
        found = stored(found)
        place = lambda df, on, x, y, name: scans.numbered(e.join(df, c("id") == c(on), "left_anti").select(*keys, "id", c(x).alias("x"), c(y).alias("y")), ["x", "y", "id"], keys, "k").select(*keys, "k", c("id").alias(name))
        ends, starts = place(found, "node", "qx", "qy", "node"), place(found, "next", "px", "py", "next")
        ahead = stored(found.select("node", "next").union(ends.alias("t").join(starts.alias("u"), same("t", "u", [*keys, "k"])).select("node", "next")))
    ranked = links.rank_cycles(ahead)
    heads = e.join(ranked.where("step = 0").select(c("node").alias("id")), "id", "left_semi").select(*keys, "id")
    parts = scans.numbered(heads, ["id"], keys, "part").select(c("id").alias("start"), (c("part") - 1).cast("int").alias("part"))
    return e.join(ranked, c("id") == c("node")).join(parts, "start").select(*keys, "part", c("step").cast("int").alias("seq"), c("px").alias("x"), c("py").alias("y"))


def dissolve(df: DataFrame, keys: Sequence[str], shape: str, order: str, digits: int = 6) -> DataFrame:
    """Outlines of each group's shapes that share edges: (keys..., part, seq, x, y). Shapes of a group must not overlap."""
    return stitch(cancelled(ring_edges(df, [*keys, shape], order, digits), keys), keys)
