"""Dissolving by edges: squares of a grid with holes, joins at a corner, and more vertices than a group."""

from millrace.operators import outlines


def squares(cells):
    return [("g", k, s, float(x + dx), float(y + dy)) for k, (x, y) in enumerate(cells) for s, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)][:: -1 if k % 2 else 1])]


def dissolved(spark, rows):
    df = spark.createDataFrame(rows, "grp string, shape int, seq int, x double, y double")
    found = {}
    for r in outlines.dissolve(df, ["grp"], "shape", "seq").collect():
        found.setdefault((r["grp"], r["part"]), {})[r["seq"]] = (r["x"], r["y"])
    rings = {k: [v[i] for i in range(len(v))] for k, v in found.items()}
    return {k: (len(r), sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1])) / 2) for k, r in rings.items()}


def test_hole_and_outline(spark):
    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    assert sorted(dissolved(spark, squares(ring)).values()) == [(4, -1.0), (12, 9.0)]


def test_squares_that_touch_at_a_corner(spark):
    assert sorted(dissolved(spark, squares([(0, 0), (1, 1)])).values()) == [(4, 1.0), (4, 1.0)]


def test_groups_and_long_outlines(spark):
    rows = squares([(k, 0) for k in range(60)]) + [("h", k, s, x, y) for _, k, s, x, y in squares([(0, 0), (5, 5)])] + [(None, k, s, x, y) for _, k, s, x, y in squares([(0, 0), (0, 1)])]
    found = dissolved(spark, rows)
    assert found == {("g", 0): (122, 60.0), ("h", 0): (4, 1.0), ("h", 1): (4, 1.0), (None, 0): (6, 2.0)}
