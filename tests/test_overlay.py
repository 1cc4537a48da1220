"""Overlay of layers: squares that cross, touch, share edges, contain each other or lie apart."""

from fractions import Fraction

import pytest

from millrace.operators import overlay, shapes

SQUARE = [(0, 0), (2, 0), (2, 2), (0, 2)]


def moved(ring, dx, dy):
    return [(x + dx, y + dy) for x, y in ring]


def layer(spark, shapes, name):
    return spark.createDataFrame([(k, i, float(x), float(y)) for k, ring in shapes.items() for i, (x, y) in enumerate(ring)], f"{name} string, seq int, x double, y double")


def areas(df):
    rings = {}
    for r in df.collect():
        rings.setdefault((r["operation"], r["l"], r["r"], r["part"]), {})[r["seq"]] = (r["x"], r["y"])
    out = {}
    for (op, a, b, _), points in rings.items():
        ring = [points[i] for i in range(len(points))]
        out.setdefault((op, a, b), []).append(round(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2, 6))
    return {k: sorted(v) for k, v in out.items()}


def test_squares(spark):
    left = {"s": SQUARE, "far": moved(SQUARE, 50, 0), "back": SQUARE[::-1] + SQUARE[-1:]}
    right = {"cross": moved(SQUARE, 1, 1), "inner": [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)], "beside": moved(SQUARE, 2, 0), "equal": SQUARE[2:] + SQUARE[:2], "half": [(0, 0), (1, 0), (1, 2), (0, 2)], "corner": moved(SQUARE, 2, 2)}
    found = areas(overlay.overlay(layer(spark, left, "l"), layer(spark, right, "r"), "l", "r", "seq", 0.75))
    for s in ("s", "back"):
        of = lambda b: [found.get((op, s, b)) for op in overlay.OPERATIONS]  # noqa: B023, E731
        assert of("cross") == [[1.0], [7.0], [3.0], [3.0, 3.0]]
        assert of("inner") == [[1.0], [4.0], [-1.0, 4.0], [-1.0, 4.0]]
        assert of("beside") == [None, [8.0], [4.0], [4.0, 4.0]]
        assert of("equal") == [[4.0], [4.0], None, None]
        assert of("half") == [[2.0], [4.0], [2.0], [2.0]]
        assert of("corner") == [None, [4.0, 4.0], [4.0], [4.0, 4.0]]
    assert not any(a == "far" for _, a, _ in found)


def test_operation_names(spark):
    with pytest.raises(ValueError):
        overlay.overlay(layer(spark, {"a": SQUARE}, "l"), layer(spark, {"b": SQUARE}, "r"), "l", "r", "seq", 1.0, ["meld"])


def test_vertices_on_the_edge_of_a_box(spark):
    """A ring that crosses a box's edge at its own vertex, and one that touches it there: areas as on paper."""
    box = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    given = {"crosses": [(3, 1), (4, 2), (6, 3), (6, 4), (3, 3)], "touches": [(1, 1), (4, 2), (1, 3)]}
    found = areas(shapes.clip(layer(spark, given, "l"), "l", "seq", box).withColumnRenamed("__clip", "r"))
    of = lambda s: [sum(found.get((op, s, 0), [])) for op in overlay.OPERATIONS]
    assert of("touches") == pytest.approx([3, 16, 0, 13])
    assert of("crosses") == pytest.approx([5 / 3, 20 - 5 / 3, 4 - 5 / 3, 20 - 10 / 3], abs=1e-5)


#: Triangles whose second vertex lies on the first edge of the other one, to six digits.
ON_EDGES = [
    ([(-0.029438, 0.025387), (-0.123806, -0.036331), (-0.115392, -0.083898)], [(-0.160991, -0.054916), (-0.091579, -0.020224), (-0.157508, 0.024901)]),
    ([(0.039392, -0.210866), (-0.009512, -0.152838), (-0.034226, -0.178879)], [(-4.8e-05, -0.190291), (-0.024072, -0.095218), (-0.097626, -0.164376)]),
    ([(-0.327152, -0.057173), (-0.231113, 0.032044), (-0.307257, 0.061903)], [(-0.169418, 0.040639), (-0.233855, 0.031662), (-0.193557, -0.021843)]),
    ([(0.112185, 0.241613), (0.019206, 0.142597), (0.025232, 0.076435)], [(0.032616, 0.106633), (0.008031, 0.172567), (-0.039017, 0.117474)]),
    ([(-0.169458, 0.114823), (-0.109595, 0.07253), (-0.020349, 0.035467)], [(-0.118937, 0.105092), (-0.093506, 0.016451), (-0.026445, 0.083659)]),
    ([(-0.159951, -0.056285), (-0.116329, -0.000511), (-0.202886, 0.077889)], [(-0.140219, -0.024621), (-0.032714, 0.083874), (-0.184112, 0.126381)]),
    ([(-0.276067, -0.022798), (-0.18459, 0.006294), (-0.28035, 0.006572)], [(-0.163184, 0.048798), (-0.215726, -0.05553), (-0.09556, -0.050654)]),
    ([(-0.171219, 0.147942), (-0.223793, 0.144863), (-0.141009, 0.069244)], [(-0.196949, 0.177647), (-0.237215, 0.128471), (-0.172824, 0.11682)]),
    ([(-0.064221, 0.102265), (-0.084496, 0.168202), (-0.150832, 0.242888)], [(-0.05407, 0.123454), (-0.090028, 0.176338), (-0.119645, 0.117534)]),
    ([(-0.02017, 0.026852), (0.05044, -0.066627), (0.119175, -0.047404)], [(0.019109, -0.036208), (0.070228, -0.085839), (0.089336, -0.015016)]),
    ([(0.027682, 0.045978), (-0.000272, 0.005945), (0.036939, -0.007989)], [(0.012206, -0.034617), (-0.006878, 0.027419), (-0.053168, -0.020775)]),
    ([(-0.161124, -0.046444), (-0.168553, -0.0736), (-0.081536, -0.114765)], [(-0.167628, -0.075329), (-0.210178, 0.004205), (-0.260484, -0.073857)]),
]


def clipped(ring, by):
    """The exact area of a ring within a convex one."""
    ring, by = ([tuple(Fraction(str(v)) for v in p) for p in r] for r in (ring, by))
    for (ax, ay), (bx, by_) in zip(by, by[1:] + by[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by_ - ay) * (p[0] - ax)  # noqa: B023, E731
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            if side(p) >= 0:
                out.append(p)
            if side(p) * side(q) < 0:
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2


def test_vertices_on_edges_by_rounding(spark):
    """Floating values see a crossing at such a vertex by either edge, by both or by none: areas as in fractions."""
    left, right = {f"{k:02}": a for k, (a, _) in enumerate(ON_EDGES)}, {f"{k:02}": b for k, (_, b) in enumerate(ON_EDGES)}
    found = areas(overlay.overlay(layer(spark, left, "l"), layer(spark, right, "r"), "l", "r", "seq", 0.1))
    for s, (a, b) in zip(left, ON_EDGES):
        inner, of_a, of_b = (float(v) for v in (clipped(a, b), clipped(a, a), clipped(b, b)))
        for op, area in zip(overlay.OPERATIONS, (inner, of_a + of_b - inner, of_a - inner, of_a + of_b - 2 * inner)):
            assert sum(found.get((op, s, s), [])) == pytest.approx(area, abs=3e-6)
