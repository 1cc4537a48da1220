"""Overlay of two layers of shapes: intersection, union, difference and exclusive-or of every pair that meets.

Edges of the two layers meet on a tree of slabs and are cut where they cross. Along a ring every crossing leads into the
other shape or out of it, so one piece is judged, by the edges of the other shape that a ray from its middle crosses, and
the others by the crossings between, counted in a scan. At edges that touch the other shape or run along it every piece
is judged by its own ray. The pieces that an operation keeps are stitched to rings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import scans, slabs
from millrace.operators.outlines import ENDS, ring_edges, stitch
from millrace.plans.session import stored

OPERATIONS = ("intersection", "union", "difference", "exclusive-or")
#: The share of an edge within which a crossing may be at an end, and of its coordinates within which a place is on it.
NEAR, NOISE = 1e-9, 4e-15


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def _boxes(edges: DataFrame, key: str, cell: float) -> DataFrame:
    box = edges.groupBy(key).agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))
    rows = box.withColumn("cx", F.explode(_cells(F.col("x0"), F.col("x1"), cell)))
    return rows.withColumn("cy", F.explode(_cells(F.col("y0"), F.col("y1"), cell)))


def _pairs(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a, b) of the shapes whose boxes meet, each once: in the cell of the boxes' common lower left corner."""
    c = F.col
    t, u = _boxes(a, "a", cell).alias("t"), _boxes(b, "b", cell).alias("u")
    meet = (c("t.x0") <= c("u.x1")) & (c("u.x0") <= c("t.x1")) & (c("t.y0") <= c("u.y1")) & (c("u.y0") <= c("t.y1"))
    corner = lambda n: F.floor(F.greatest(f"t.{n}", f"u.{n}") / cell)
    here = (corner("x0") == c("t.cx")) & (corner("y0") == c("t.cy"))
    return t.join(u, (c("t.cx") == c("u.cx")) & (c("t.cy") == c("u.cy"))).where(meet & here).select("a", "b")


def _cuts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, own, e, t, x, y, cut, plain): where edge e of a shape (own: 0 of a, 1 of b) meets the other one, at the
    share t; whether it is cut there; and whether it crosses plainly there, away from the ends of both edges.

    Two edges are cut where they cross within both, by their coordinates' floating values. At a vertex on the other
    shape's edge these may see a crossing by either edge of the vertex, by both or by none; where a ring that goes over
    to the other side there would be lost by all, the edge is cut at the vertex.
    """
    c = F.col
    rings = lambda df, k: df.join(df.groupBy(k).agg(F.min("e").alias("ring")), k)
    met = slabs.meeting(rings(a, "a"), rings(b, "b"))
    x = met.join(a.alias("s"), c("ea") == c("s.e")).join(b.alias("r"), c("eb") == c("r.e"))
    apart = (F.greatest("s.px", "s.qx") < F.least("r.px", "r.qx")) | (F.greatest("r.px", "r.qx") < F.least("s.px", "s.qx")) | (F.greatest("s.py", "s.qy") < F.least("r.py", "r.qy")) | (F.greatest("r.py", "r.qy") < F.least("s.py", "s.qy"))
    x = x.where(~apart)
    dx, dy, ex, ey = c("s.qx") - c("s.px"), c("s.qy") - c("s.py"), c("r.qx") - c("r.px"), c("r.qy") - c("r.py")
    wx, wy = c("r.px") - c("s.px"), c("r.py") - c("s.py")
    cross = dx * ey - dy * ex
    x = x.select(c("s.a").alias("a"), c("r.b").alias("b"), "ea", "eb", *[c(f"{t}.{n}").alias(f"{t}{n}") for t in "sr" for n in ENDS], cross.alias("cross"), (wx * ey - wy * ex).alias("tn"), (wx * dy - wy * dx).alias("un"), (dx * dx + dy * dy).alias("dd"), (ex * ex + ey * ey).alias("ee"))
    t, u = F.try_divide("tn", "cross"), F.try_divide("un", "cross")
    crossing = F.coalesce((t > 0) & (t < 1) & (u > 0) & (u < 1), F.lit(False))
    point = lambda n: c(f"sp{n}") + t * (c(f"sq{n}") - c(f"sp{n}"))
    level = (c("cross") == 0) & (c("tn") == 0) & (c("un") == 0)  # on one line: cut at the other's ends
    share = lambda of, end, size: ((c(f"{end}x") - c(f"{of}px")) * (c(f"{of}qx") - c(f"{of}px")) + (c(f"{end}y") - c(f"{of}py")) * (c(f"{of}qy") - c(f"{of}py"))) / c(size)
    beside = F.abs("cross") <= NEAR * F.sqrt(c("dd") * c("ee"))
    plain = ~beside & t.between(NEAR, 1 - NEAR) & u.between(NEAR, 1 - NEAR)
    near = beside | (t.between(-NEAR, 1 + NEAR) & u.between(-NEAR, 1 + NEAR))

    def off(of: str, end: str) -> Column:
        """Which side of an edge a place is on; 0 on its line, as far as its coordinates tell."""
        run, rise = c(f"{of}qx") - c(f"{of}px"), c(f"{of}qy") - c(f"{of}py")
        turn = (c(f"{of}px") - c(f"{end}x")) * rise - (c(f"{of}py") - c(f"{end}y")) * run
        return F.when(F.abs(turn) > NOISE * F.greatest(*[F.abs(f"{of}{n}") for n in ENDS]) * (F.abs(run) + F.abs(rise)), F.signum(turn)).otherwise(0.0)

    def cut(when: Column, own: int, e: str, at: Column, px: Column, py: Column, is_cut: bool = True, side: Column | None = None) -> Column:
        held = F.lit(False) if side is not None or not is_cut else plain
        return F.when(when, F.struct(F.lit(own).alias("own"), c(e).alias("e"), at.alias("t"), px.alias("x"), py.alias("y"), F.lit(is_cut).alias("cut"), held.alias("plain"), (F.lit(None).cast("double") if side is None else side).alias("side")))

    cuts = [cut(crossing, 0, "ea", t, point("x"), point("y")), cut(crossing, 1, "eb", u, point("x"), point("y"))]
    for end, far in (("p", "q"), ("q", "p")):
        cuts.append(cut(level, 0, "ea", share("s", f"r{end}", "dd"), c(f"r{end}x"), c(f"r{end}y")))
        cuts.append(cut(level, 1, "eb", share("r", f"s{end}", "ee"), c(f"s{end}x"), c(f"s{end}y")))
        # a vertex on an edge, with the side that its own edge comes from or goes to
        for own, e, of, to, size in ((0, "ea", "s", "r", "dd"), (1, "eb", "r", "s", "ee")):
            cuts.append(cut(off(of, f"{to}{end}") == 0, own, e, share(of, f"{to}{end}", size), c(f"{to}{end}x"), c(f"{to}{end}y"), side=off(of, f"{to}{far}")))
    nothing = F.lit(0.0)
    cuts += [cut(near & ~plain, own, e, nothing, nothing, nothing, False) for own, e in ((0, "ea"), (1, "eb"))]
    k = x.select("a", "b", crossing.alias("seen"), F.explode(F.array_compact(F.array(*cuts))).alias("k")).select("a", "b", "seen", "k.*").where(~c("cut") | ((c("t") > 0) & (c("t") < 1)))
    names = ["a", "b", "own", "e", "t", "x", "y", "cut", "plain"]
    met_once = k.groupBy(*names, c("side").isNotNull().alias("vertex")).agg(F.max("seen").alias("seen"), F.min("side").alias("low"), F.max("side").alias("high"))
    return met_once.where("not vertex or (not seen and low <= 0 and high >= 0)").select(*names).distinct()


def _pieces(edges: DataFrame, pairs: DataFrame, cuts: DataFrame, own: int) -> DataFrame:
    """(a, b, own, px, py, qx, qy, place, t, turn, unsure) of a layer's edges in every pair, in pieces between their cuts;
    turn is 1 after a plain crossing, unsure 1 on edges that touch the other shape or run along it."""
    c = F.col
    of = edges.join(pairs, "ab"[own])
    end = lambda t, x, y: F.struct(F.lit(t).alias("t"), c(x).alias("x"), c(y).alias("y"), F.lit(True).alias("cut"), F.lit(True).alias("plain"))
    ends = of.select("a", "b", "e", "place", F.explode(F.array(end(0.0, "px", "py"), end(1.0, "qx", "qy"))).alias("k")).select("a", "b", "e", "place", "k.*")
    met = cuts.where(c("own") == own).join(edges.select("e", "place"), "e")
    points = ends.union(met.select("a", "b", "e", "place", "t", "x", "y", "cut", "plain"))
    edge = Window.partitionBy("a", "b", "e")
    w = edge.orderBy("t", "x", "y")
    unsure = F.max(F.when(c("plain"), 0).otherwise(1)).over(edge)
    found = points.withColumn("unsure", unsure).where("cut").groupBy("a", "b", "e", "place", "t", "x", "y", "unsure").agg(F.count("*").alias("n"))
    turn = F.when(c("t") > 0, c("n")).otherwise(0)
    return found.select("a", "b", F.lit(own).alias("own"), c("x").alias("px"), c("y").alias("py"), F.lead("x").over(w).alias("qx"), F.lead("y").over(w).alias("qy"), "place", "t", turn.alias("turn"), "unsure").where("qx is not null")


def _ray(pieces: DataFrame, edges: DataFrame, other: str, cell: float) -> DataFrame:
    """Adds odd: whether the piece's middle is in the other shape, by the even-odd rule along a ray."""
    c = F.col
    middle = pieces.withColumns({"id": F.monotonically_increasing_id(), "mx": (c("px") + c("qx")) / 2, "my": (c("py") + c("qy")) / 2})
    middle = stored(middle.withColumn("strip", F.floor(c("my") / cell)))
    rows = edges.select(c(other).alias("o"), *[c(n).alias(f"e{n}") for n in ENDS], F.explode(_cells(F.least("py", "qy"), F.greatest("py", "qy"), cell)).alias("strip_of"))
    hit = ((c("epy") > c("my")) != (c("eqy") > c("my"))) & (c("mx") < (c("eqx") - c("epx")) * (c("my") - c("epy")) / F.when(c("eqy") != c("epy"), c("eqy") - c("epy")) + c("epx"))
    counted = middle.join(rows, (c(other) == c("o")) & (c("strip") == c("strip_of"))).where(hit).groupBy("id").agg((F.count("*") % 2 == 1).alias("odd"))
    return middle.join(counted, "id", "left").select(*pieces.columns, F.coalesce("odd", F.lit(False)).alias("odd"))


def _inside(pieces: DataFrame, edges: DataFrame, other: str, cell: float) -> DataFrame:
    """Adds inside: whether a piece is in the other shape, by the crossings between it and the longest piece of its
    stretch, whose middle has a ray. A stretch is what follows without an unsure edge, and each piece of such an edge."""
    c = F.col
    stretch = ["a", "b", "own", "breaks", "unsure"]
    along = scans.running_sums(pieces, {"breaks": c("unsure").cast("long"), "turns": c("turn").cast("long")}, ["place", "t", "px", "py"], ["a", "b", "own"]).where("px <> qx or py <> qy")
    longest = along.groupBy(*stretch).agg(F.max_by(F.struct(*ENDS, "turns"), (c("qx") - c("px")) ** 2 + (c("qy") - c("py")) ** 2).alias("k"))
    judged = _ray(longest.select(*stretch, "k.*").withColumnRenamed("turns", "from"), edges, other, cell).select(*stretch, "from", "odd")
    return along.join(judged, stretch).select("a", "b", "own", *ENDS, (c("odd") != (F.abs(c("turns") - c("from")) % 2 == 1)).alias("inside"))


def overlay(left: DataFrame, right: DataFrame, left_id: str, right_id: str, order: str, cell: float, operations: Sequence[str] = OPERATIONS) -> DataFrame:
    """(operation, left_id, right_id, part, seq, x, y): rings of the combination of each pair of shapes whose boxes meet.

    A shape is one simple ring of vertices in ``order``; its direction and closing vertex do not matter. Outlines come
    counter-clockwise, holes clockwise; an operation that leaves nothing has no rows. Edges that both shapes have count
    once. ``cell`` is the side of the grid's cells, best a few edges wide. Shapes without an id are left out.
    """
    c = F.col
    unknown = set(operations) - set(OPERATIONS)
    if unknown:
        raise ValueError(f"no such operation: {', '.join(sorted(unknown))}")
    a, b = (stored(ring_edges(df.where(c(k).isNotNull()).select(c(k).alias(n), c(order).alias("o"), "x", "y"), [n], "o", place="place").withColumn("e", F.monotonically_increasing_id())) for df, k, n in ((left, left_id, "a"), (right, right_id, "b")))
    pairs = stored(_pairs(a, b, cell))
    cuts = stored(_cuts(a, b))
    of_a, of_b = _inside(_pieces(a, pairs, cuts, 0), b, "b", cell), _inside(_pieces(b, pairs, cuts, 1), a, "a", cell)
    # pieces that both have, in the same direction or against each other
    forward = F.struct("px", "py") < F.struct("qx", "qy")
    line = [F.when(forward, c(n)).otherwise(c(m)).alias(f"l{n}") for n, m in zip(ENDS, ("qx", "qy", "px", "py"))]
    both = of_a.union(of_b).select("*", *line, forward.alias("forward"))
    shared = F.count("*").over(Window.partitionBy("a", "b", *[f"l{n}" for n in ENDS])) > 1
    directions = F.size(F.collect_set("forward").over(Window.partitionBy("a", "b", *[f"l{n}" for n in ENDS])))
    kind = F.when(shared, F.when(directions == 1, "same").otherwise("against")).otherwise(F.when(c("inside"), "in").otherwise("out"))
    pieces = stored(both.select("a", "b", "own", *ENDS, kind.alias("kind")))
    is_a = c("own") == 0
    # each set of edges is stitched once: pieces as they run, pieces turned round
    sets = {
        "within": ((c("kind") == "in") | ((c("kind") == "same") & is_a), F.lit(False)),
        "around": ((c("kind") == "out") | ((c("kind") == "same") & is_a), F.lit(False)),
        "a less b": (is_a & c("kind").isin("out", "against"), ~is_a & (c("kind") == "in")),
        "b less a": (~is_a & c("kind").isin("out", "against"), is_a & (c("kind") == "in")),
    }
    wanted = {"intersection": ["within"], "union": ["around"], "difference": ["a less b"], "exclusive-or": ["a less b", "b less a"]}
    needed = {of for op in operations for of in wanted[op]}
    use = [F.when(ahead | turned, F.struct(F.lit(of).alias("set"), turned.alias("turned"))) for of, (ahead, turned) in sets.items() if of in needed]
    chosen = pieces.select("a", "b", *ENDS, F.explode(F.array_compact(F.array(*use))).alias("k")).select("a", "b", *ENDS, "k.*")
    swap = lambda n, m: F.when(c("turned"), c(m)).otherwise(c(n)).alias(n)
    rings = stitch(chosen.select("set", "a", "b", swap("px", "qx"), swap("py", "qy"), swap("qx", "px"), swap("qy", "py")), ["set", "a", "b"])
    uses = [F.when(c("set") == of, F.struct(F.lit(op).alias("operation"), F.lit(side).alias("side"))) for op in operations for side, of in enumerate(wanted[op])]
    found = rings.withColumn("k", F.explode(F.array_compact(F.array(*uses)))).select("*", "k.*")
    return found.select("operation", c("a").alias(left_id), c("b").alias(right_id), (2 * c("part") + c("side")).alias("part") if "exclusive-or" in operations else "part", "seq", "x", "y")
