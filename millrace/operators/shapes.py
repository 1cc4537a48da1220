"""Shape operators over vertex tables: as rounds over all shapes at once, or with each shape as one group of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import outlines, overlay, rings, scans, slabs
from millrace.plans.session import stored

#: Chords of so many vertices are no longer one window's group; levels of shorter ones that follow in one job.
LONG_CHORD, LEVELS = 1 << 16, 6
#: Vertices, by estimate, of the mountains that are cut in triangles as one group of rows.
MOUNTAINS = 8_000


def _points(pdf: pd.DataFrame, order: str) -> list[tuple[float, float]]:
    pdf = pdf.sort_values(order)
    return list(zip(pdf["x"].astype(float), pdf["y"].astype(float)))


def simplify(df: DataFrame, keys: Sequence[str], order: str, distance: float = 0.0001, most: int = LONG_CHORD) -> DataFrame:
    """Douglas-Peucker on each part: ends stay, and any vertex farther than ``distance`` from the line of its chord.

    A ring (first vertex = last) is first split at the vertex farthest from its start. All open chords of all parts are
    worked on at once: chords whose farthest vertex (ties: the first) is beyond the distance are split there, and the
    vertices of the others drop out. For chords of more than ``most`` vertices that is an aggregation and a join for
    each level; shorter ones are windows within a task, LEVELS levels a job. Parts may be of any size.
    Rows stay as they are or go; null keys are keys like any other, missing coordinates count as 0.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    c = F.col
    same = lambda t, u: reduce(lambda x, y: x & y, [c(f"{t}.{n}").eqNullSafe(c(f"{u}.{n}")) for n in names])
    rows = stored(scans.numbered(df, [order], keys, "__i"))
    v = rows.select(*[c(k).alias(n) for k, n in zip(keys, names)], "__i", F.coalesce(c("x").cast("double"), F.lit(0.0)).alias("px"), F.coalesce(c("y").cast("double"), F.lit(0.0)).alias("py"))
    at = F.struct(c("__i").alias("i"), "px", "py")
    ends = stored(v.groupBy(*names).agg(F.min_by(at, "__i").alias("a"), F.max_by(at, "__i").alias("b")))
    ring = (c("b.i") > c("a.i") + 1) & (c("a.px") == c("b.px")) & (c("a.py") == c("b.py"))
    apart = (c("px") - c("a.px")) ** 2 + (c("py") - c("a.py")) ** 2
    rings = v.alias("t").join(ends.where(ring).alias("u"), same("t", "u")).select(*[f"t.{n}" for n in names], "__i", "px", "py", "a")
    far = rings.groupBy(*names).agg(F.max_by(at, F.struct(apart, -c("__i"))).alias("m"))
    chords = stored(ends.alias("t").join(far.alias("u"), same("t", "u"), "left").select(*[f"t.{n}" for n in names], "a", "b", "m"))
    kept = [chords.select(*names, F.explode(F.array_compact(F.array("a.i", "b.i", "m.i"))).alias("__i"))]
    first = c("m").isNull() | (c("__i") < c("m.i"))
    opened = v.alias("t").join(chords.alias("u"), same("t", "u")).where((c("__i") > c("a.i")) & (c("__i") < c("b.i")) & (c("m").isNull() | (c("__i") != c("m.i"))))
    opened = opened.select(*[f"t.{n}" for n in names], "__i", "px", "py", F.when(first, c("a")).otherwise(c("m")).alias("a"), F.when(first, F.coalesce("m", "b")).otherwise(c("b")).alias("b"))
    dx, dy = c("b.px") - c("a.px"), c("b.py") - c("a.py")
    qx, qy = c("px") - c("a.px"), c("py") - c("a.py")
    length = F.sqrt(dx * dx + dy * dy)
    gap = F.when(length > 0, F.abs(dx * qy - dy * qx) / length).otherwise(F.sqrt(qx * qx + qy * qy))
    best, before, cut = F.struct(gap, -c("__i")), c("__i") < c("m.i"), c("__i") == c("m.i")
    # a cut is a chord from itself to itself: it is kept and not worked on again
    halves = (F.when(before, c("a")).otherwise(c("m")).alias("a"), F.when(before | cut, c("m")).otherwise(c("b")).alias("b"))
    is_cut, is_long = c("a.i") == c("b.i"), c("b.i") - c("a.i") > most
    opened = stored(opened)
    short, long = [opened.where(~is_long)], opened.where(is_long)
    while not long.isEmpty():
        farthest = long.groupBy(*names, c("a.i").alias("__a")).agg(F.max_by(at, best).alias("m"), F.max(gap).alias("gap")).where(c("gap") > distance)
        split = long.alias("t").join(farthest.alias("u"), same("t", "u") & (c("t.a.i") == c("__a")))
        now = stored(split.select(*[f"t.{n}" for n in names], "__i", "px", "py", *halves))
        short.append(now.where(~is_long))
        long = now.where(is_long)
    # chords that fit in a task: their vertices are dealt once, and several levels follow without another shuffle
    now = reduce(DataFrame.union, short)
    kept.append(now.where(is_cut).select(*names, "__i"))
    opened = now.where(~is_cut)
    chord = Window.partitionBy(*names, "__g", "a.i", "b.i")
    while True:
        now = opened.withColumn("__g", c("a.i")).repartition(*names, "__g")
        for _ in range(LEVELS):
            level = now.withColumns({"m": F.when(~is_cut, F.max_by(at, best).over(chord)).otherwise(c("a")), "gap": F.max(gap).over(chord)}).where(is_cut | (c("gap") > distance))
            now = level.select(*names, "__g", "__i", "px", "py", *halves)
        now = stored(now.drop("__g"))
        kept.append(now.where(is_cut).select(*names, "__i"))
        opened = now.where(~is_cut)
        if opened.isEmpty():
            break
    chosen = reduce(DataFrame.union, kept).withColumnRenamed("__i", "__kept_i")
    on = reduce(lambda x, y: x & y, [c(k).eqNullSafe(c(n)) for k, n in zip(keys, names)], c("__i") == c("__kept_i"))
    return rows.join(chosen, on, "left_semi").select(*df.columns)


def cut_overlap(df: DataFrame, keys: Sequence[str], order: str, distance: float = 1e-6) -> DataFrame:
    """Drops the tail of a loop that repeats its head, usually the closing point."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.iloc[: rings.overlap_end(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), distance)]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def thin_parts(df: DataFrame, keys: Sequence[str], order: str, distance: float, euclid: bool = False) -> DataFrame:
    """Greedy thinning of long parts, in numpy; ``rows.thin`` is its expression for short ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        keep, last = np.zeros(len(x), bool), 0
        for i in range(len(x)):
            dx, dy = abs(x[i] - x[last]), abs(y[i] - y[last])
            if i == 0 or not ((dx * dx + dy * dy < distance * distance) if euclid else (dx < distance and dy < distance)):
                keep[i], last = True, i
        return pdf[keep]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def tessellate(df: DataFrame, shape: str, part: str, order: str) -> DataFrame:
    """(shape, triangle, corner, x, y): triangles of each shape, its parts being rings and holes by the odd rule.

    Each vertex is dealt to the edges straight above and below it through the inside. An edge, and the vertices that it
    was dealt, bound one mountain over that edge, and the mountains part the shape: triangles are cut off each of them
    along its vertices. No task holds a shape; a mountain is in one.
    """
    c = F.col
    edges = outlines.ring_edges(df.select(c(shape).alias("s"), c(part).alias("p"), c(order).alias("o"), "x", "y"), ["s", "p"], "o", None)
    edges = stored(edges.withColumn("e", F.monotonically_increasing_id()))
    names = stored(edges.groupBy("s").agg(F.min("e").alias("ring")))
    edges = stored(edges.alias("t").join(names.alias("u"), outlines.same("t", "u", ["s"])).select("ring", "e", *outlines.ENDS))
    places = edges.select("ring", c("e").alias("v"), c("px").alias("x"), c("py").alias("y"))
    groups = max(1, edges.count() // MOUNTAINS)
    seen = slabs.seen(edges, places).join(places.drop("ring"), "v").join(edges, "e").withColumn("group", F.pmod(F.xxhash64("e"), F.lit(groups)))
    corners = ("ax", "ay", "bx", "by", "cx", "cy")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, found = pdf.sort_values(["e", "side", "x", "y"]), []
        of = pdf[["e", "side"]].to_numpy()
        start = np.flatnonzero(np.append(True, (of[1:] != of[:-1]).any(axis=1)))
        heads = pdf[["ring", "e", "side", *outlines.ENDS]].iloc[start].itertuples(index=False, name=None)
        places = list(zip(pdf["x"].tolist(), pdf["y"].tolist()))
        for (ring, e, side, px, py, qx, qy), i, j in zip(heads, start.tolist(), [*start[1:].tolist(), len(pdf)]):
            first, last = sorted([(px, py), (qx, qy)])
            kept = [first]
            for p in [*dict.fromkeys(places[i:j]), last]:
                while len(kept) > 1:
                    a, b = kept[-2:]
                    if side * ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) <= 0:
                        break
                    found.append((ring, e, len(found), *a, *(b + p if side > 0 else p + b)))
                    kept.pop()
                kept.append(p)
        return pd.DataFrame(found, columns=["ring", "e", "k", *corners])

    # stored: numbering by ranges reads its table twice
    found = stored(seen.groupBy("group").applyInPandas(cut, "ring bigint, e bigint, k bigint, " + ", ".join(f"{n} double" for n in corners)))
    triangles = scans.numbered(found, ["e", "k"], ["ring"], "n")
    rows = triangles.join(names, "ring").select("s", (c("n") - 1).cast("int").alias("triangle"), F.posexplode(F.array(*[F.struct(c(f"{n}x").alias("x"), c(f"{n}y").alias("y")) for n in "abc"])).alias("corner", "at"))
    return rows.select(c("s").alias(shape), "triangle", "corner", "at.x", "at.y")


def clip(df: DataFrame, shape: str, order: str, ring: list[tuple[float, float]], *operations: str) -> DataFrame:
    """Each shape whose box meets the ring's combined with it: (operation, shape, __clip, part, seq, x, y), all four
    operations if none is named. The ring is a layer of one shape."""
    layer = df.sparkSession.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(ring)], "__clip int, __seq int, x double, y double").withColumnRenamed("__seq", order)
    xs, ys = zip(*ring)
    cell = max(max(xs) - min(xs), max(ys) - min(ys), 1e-9) / 4
    return overlay.overlay(df, layer, shape, "__clip", order, cell, operations or overlay.OPERATIONS)


def place_beside(a: DataFrame, b: DataFrame, axis: str = "auto", gap: float = 0.0) -> DataFrame:
    """``a`` and, beside it, ``b`` shifted along an axis (by default the shorter side of ``a``)."""
    box = a.agg(*[f(c).alias(f"a_{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)])
    own = b.agg(*[F.min(c).alias(f"b_min_{c}") for c in ("x", "y")])
    ends = F.broadcast(box.join(own))
    wide, tall = F.col("a_max_x") - F.col("a_min_x"), F.col("a_max_y") - F.col("a_min_y")
    along_x = {"x": F.lit(True), "y": F.lit(False)}.get(axis, wide <= tall)
    dx = F.when(along_x, F.col("a_max_x") + gap - F.col("b_min_x")).otherwise(0.0)
    dy = F.when(along_x, 0.0).otherwise(F.col("a_max_y") + gap - F.col("b_min_y"))
    moved = b.join(ends).withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy}).select(*b.columns)
    return a.select(*b.columns).union(moved)
