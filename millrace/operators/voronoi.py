"""Voronoi cells across tasks: each site's cell from its nearest sites, final once no other site can cut it.

A cell is cut out of the box by the bisectors with the nearest sites known. If every site within twice the distance of its
farthest corner was among them, no further one can reach it (the security radius) and the cell is final. The others
go on with twice as many sites from blocks twice as large. Where to begin comes from counts of sites per block of 1,
2, 4 ... cells, so a dense place and an empty one both start with about as many neighbours; the smallest cells are so
small that none holds many sites.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.outlines import same
from millrace.plans.session import stored

#: Sites that a cell is first cut by.
NEIGHBOURS = 24


def _clipped(ring: Column, ox: Column, oy: Column, q: Column) -> Column:
    """The part of a convex ring that is nearer to (ox, oy) than to q."""
    dx, dy = q["x"] - ox, q["y"] - oy
    mx, my = (ox + q["x"]) / 2, (oy + q["y"]) / 2
    side = lambda p: (p["x"] - mx) * dx + (p["y"] - my) * dy
    sided = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), side(p).alias("s")))
    following = F.concat(F.slice(sided, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(sided, 1, 1))
    pairs = F.zip_with(sided, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def kept(e: Column) -> Column:
        a, b = e["a"], e["b"]
        k = a["s"] / F.when(a["s"] != b["s"], a["s"] - b["s"])
        at = F.struct((a["x"] + k * (b["x"] - a["x"])).alias("x"), (a["y"] + k * (b["y"] - a["y"])).alias("y"))
        return F.array_compact(F.array(F.when(a["s"] <= 0, F.struct(a["x"].alias("x"), a["y"].alias("y"))), F.when(a["s"] * b["s"] < 0, at)))

    return F.flatten(F.transform(pairs, kept))


def voronoi(df: DataFrame, group: str, point: str, box: tuple[float, float, float, float], most: int = NEIGHBOURS) -> DataFrame:
    """(group, point, seq, x, y): the corners of each site's cell within ``box`` (x0, y0, x1, y1), against the clock.

    Sites at one place are one, the smallest ``point``; sites without a coordinate have no cell; a null group is a group.
    """
    c = F.col
    x0, y0, x1, y1 = map(float, box)
    places = df.where("x is not null and y is not null").select(c(group).alias("g"), c(point).alias("p"), *[c(a).cast("double").alias(a) for a in ("x", "y")])
    sites = stored(places.groupBy("g", "x", "y").agg(F.min("p").alias("p")))
    ends = sites.agg(F.max(F.abs("x")), F.max(F.abs("y"))).first()
    extent = 2 * max(abs(x0), abs(x1), abs(y0), abs(y1), *(e or 0.0 for e in ends))
    cell, top = extent, 0
    place = lambda n, size: F.floor(c(n) / size).cast("long")
    while top < 40 and (sites.groupBy("g", place("x", cell), place("y", cell)).count().agg(F.max("count")).first()[0] or 0) > most:
        cell, top = cell / 4, top + 2
    top += 2  # blocks of this level lie around the whole extent
    block = lambda n: F.call_function("shiftright", c(n), c("level"))
    placed = sites.withColumns({"cx": place("x", cell), "cy": place("y", cell)})
    near = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])

    def around(rows: DataFrame) -> DataFrame:
        spread = rows.withColumn("i", F.explode(near)).withColumn("j", F.explode(near))
        return spread.withColumns({"bx": block("cx") + c("i"), "by": block("cy") + c("j")}).drop("i", "j")

    levels = F.sequence(F.lit(0), F.lit(top))
    counts = placed.groupBy("g", "cx", "cy").agg(F.count("*").alias("n")).withColumn("level", F.explode(levels)).groupBy("g", "level", block("cx").alias("bx"), block("cy").alias("by")).agg(F.sum("n").alias("n"))
    # of each cell, not of each site
    cells = placed.select("g", "cx", "cy").distinct().withColumn("level", F.explode(levels))
    enough = around(cells).alias("t").join(counts.alias("u"), same("t", "u", ["g", "level", "bx", "by"])).groupBy("t.g", "cx", "cy", "t.level").agg(F.sum("n").alias("n")).where((c("n") > most) | (c("level") == top))
    first = enough.groupBy("g", "cx", "cy").agg(F.min("level").alias("level"))
    open_ = stored(placed.alias("t").join(first.alias("u"), same("t", "u", ["g", "cx", "cy"])).select("t.*", "level").withColumn("m", F.lit(most)))
    corners = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    done = []
    while not open_.isEmpty():
        used = F.array(*[F.lit(r[0]) for r in open_.select("level").distinct().collect()])  # no more than the levels
        dealt = placed.withColumn("level", F.explode(used)).select("g", "level", block("cx").alias("bx"), block("cy").alias("by"), c("x").alias("qx"), c("y").alias("qy"))
        met = around(open_).alias("t").join(dealt.alias("u"), same("t", "u", ["g", "level", "bx", "by"])).where("x <> qx or y <> qy")
        gap = (c("qx") - c("x")) ** 2 + (c("qy") - c("y")) ** 2
        w = Window.partitionBy("t.g", "p").orderBy("d", "qx", "qy")
        ranked = met.select("t.g", "p", "m", gap.alias("d"), "qx", "qy").withColumn("k", F.row_number().over(w)).where(c("k") <= c("m"))
        known = ranked.groupBy("g", "p").agg(F.array_sort(F.collect_list(F.struct("d", c("qx").alias("x"), c("qy").alias("y")))).alias("others"))  # at most m
        rows = open_.alias("t").join(known.alias("u"), same("t", "u", ["g", "p"]), "left").select("t.*", F.coalesce("others", F.expr("cast(array() as array<struct<d: double, x: double, y: double>>)")).alias("others"))
        whole = F.when(c("level") == top, F.lit(math.inf)).otherwise((F.lit(cell) * F.pow(F.lit(2.0), c("level"))) ** 2)
        reach = F.when(F.size("others") < c("m"), whole).otherwise(F.least(whole, F.element_at("others", -1)["d"]))
        cut = rows.withColumns({"ring": F.aggregate("others", corners, lambda ring, q: _clipped(ring, c("x"), c("y"), q)), "reach": F.when(F.size("others") == 0, whole).otherwise(reach)})
        far = F.coalesce(F.array_max(F.transform("ring", lambda v: (v["x"] - c("x")) ** 2 + (v["y"] - c("y")) ** 2)), F.lit(0.0))
        now = stored(cut.withColumn("final", (4 * far <= c("reach")) | (F.size("ring") == 0)).drop("others"))
        done.append(now.where("final").select("g", "p", "ring"))
        open_ = now.where("not final").select(*placed.columns, F.least(c("level") + 1, F.lit(top)).alias("level"), (2 * c("m")).alias("m"))
    if not done:
        return places.where(F.lit(False)).select(c("g").alias(group), c("p").alias(point), F.lit(0).alias("seq"), "x", "y")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found.select(c("g").alias(group), c("p").alias(point), F.posexplode("ring").alias("seq", "v")).select(group, point, "seq", "v.x", "v.y")


def holders(cells: DataFrame, probes: DataFrame, group: str, point: str, probe: str) -> DataFrame:
    """(probe, point): the cells of ``voronoi`` that hold each probe (probe, group, px, py), edges included.

    A cell is dealt to the blocks that its box touches, of the size of the box; a probe has one block for each size in
    use, so it meets the few cells whose boxes are near it, however many cells its group has.
    """
    c = F.col
    corner = F.struct(c("seq"), c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))
    rings = cells.groupBy(c(group).alias("g"), c(point).alias("p")).agg(F.array_sort(F.collect_list(corner)).alias("ring"), *[f(n).cast("double").alias(f"{n}{k}") for n in "xy" for k, f in ((0, F.min), (1, F.max))])
    wide = F.greatest(c("x1") - c("x0"), c("y1") - c("y0"))
    far = F.greatest(*[F.abs(n) for n in ("x0", "x1", "y0", "y1")])
    top = rings.agg(F.max(far)).first()[0]
    if top is None:
        return probes.crossJoin(cells.select(c(point).alias("p"))).select(probe, c("p").alias(point)).limit(0)
    least = math.ceil(math.log2(max(top, 1e-300))) - 45  # the blocks' numbers are longs
    sized = stored(rings.withColumn("level", F.greatest(F.when(wide > 0, F.ceil(F.log2(wide))).otherwise(least), F.lit(least)).cast("int")))
    size = F.pow(F.lit(2.0), c("level"))
    touched = lambda n: F.explode(F.sequence(F.floor(c(f"{n}0") / size - 1e-6).cast("long"), F.floor(c(f"{n}1") / size + 1e-6).cast("long")))
    dealt = sized.withColumn("bx", touched("x")).withColumn("by", touched("y"))
    used = F.array(*[F.lit(r[0]) for r in sized.select("level").distinct().collect()])  # one for each doubling of a cell
    placed = probes.select(c(probe).alias("__probe"), c(group).alias("g"), c("px").cast("double").alias("px"), c("py").cast("double").alias("py")).where(F.greatest(F.abs("px"), F.abs("py")) <= 2 * top).withColumn("level", F.explode(used))
    placed = placed.withColumns({"bx": F.floor(c("px") / size).cast("long"), "by": F.floor(c("py") / size).cast("long")})
    following = lambda i: F.element_at("ring", F.when(i + 1 < F.size("ring"), i + 2).otherwise(1))
    edges = F.transform("ring", lambda a, i: F.struct(a.alias("a"), following(i).alias("b")))
    inside = F.forall(edges, lambda e: ~((e["b"]["x"] - e["a"]["x"]) * (c("py") - e["a"]["y"]) < (e["b"]["y"] - e["a"]["y"]) * (c("px") - e["a"]["x"])))
    return placed.join(dealt, ["g", "level", "bx", "by"]).where(inside).select(c("__probe").alias(probe), c("p").alias(point))
