"""Simplification as rounds over all chords, against a stack of one part's chords."""

import math
import random

import pytest

from millrace.operators import shapes


def wanted(points, distance):
    n = len(points)
    keep = {0, n - 1}
    spans = [(0, n - 1)]
    if n > 2 and points[0] == points[-1]:
        far = max(range(n), key=lambda i: ((points[i][0] - points[0][0]) ** 2 + (points[i][1] - points[0][1]) ** 2, -i))
        keep.add(far)
        spans = [(0, far), (far, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        dx, dy = points[b][0] - points[a][0], points[b][1] - points[a][1]
        length = math.sqrt(dx * dx + dy * dy)

        def gap(i):
            qx, qy = points[i][0] - points[a][0], points[i][1] - points[a][1]
            return abs(dx * qy - dy * qx) / length if length > 0 else math.sqrt(qx * qx + qy * qy)

        m = max(range(a + 1, b), key=lambda i: (gap(i), -i))
        if gap(m) > distance:
            keep.add(m)
            spans += [(a, m), (m, b)]
    return sorted(keep)


@pytest.mark.parametrize("most", [4, 1 << 16])
def test_simplify(spark, most):
    rng = random.Random(most)
    parts = {}
    for k in range(12):
        walk, x, y = [], 0.0, 0.0
        for _ in range(rng.randrange(1, 90)):
            x, y = x + rng.choice([0, 1, 2]), y + rng.choice([-1, 0, 1])
            walk.append((float(x), float(y)))
        parts[("w", k)] = walk + ([walk[0]] if k % 3 == 0 else [])
    parts[("w", None)] = [(0.0, 0.0), (1.0, 0.0), (2.0, 3.0)]
    parts["flat", 1] = [(float(k), 2.0 * k) for k in range(5)]
    parts["ring", 1] = [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (1.0, -0.01), (0.0, 0.0)]
    parts["same", 1] = [(1.0, 1.0)] * 4
    rows = [(a, b, i, x, y, "kept") for (a, b), p in parts.items() for i, (x, y) in enumerate(p)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, b int, seq int, x double, y double, note string")
    found = {}
    for r in shapes.simplify(df, ["a", "b"], "seq", 1.5, most).collect():
        found.setdefault((r["a"], r["b"]), []).append(r["seq"])
        assert r["note"] == "kept"
    assert {k: sorted(v) for k, v in found.items()} == {k: wanted(p, 1.5) for k, p in parts.items()}


def test_nothing(spark):
    assert shapes.simplify(spark.createDataFrame([], "k int, seq int, x double, y double"), ["k"], "seq").count() == 0
