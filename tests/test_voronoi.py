"""Voronoi cells against the nearest site, with clusters, lone sites and more neighbours than a first round takes."""

import math
import random

import pytest

from millrace.operators import voronoi


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


@pytest.mark.parametrize("most", [3, 24])
def test_cells(spark, most):
    rng = random.Random(most)
    sites = {"even": [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(60)]}
    sites["cluster"] = [(0.9 + rng.uniform(0, 1e-3), 0.1 + rng.uniform(0, 1e-3)) for _ in range(60)] + [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(8)]
    sites["wheel"] = [(0.5, 0.5)] + [(0.5 + 0.3 * math.cos(k / 5), 0.5 + 0.3 * math.sin(k / 5)) for k in range(31)]
    sites["lone"] = [(0.2, 0.7)]
    sites["pair"] = [(0.25, 0.5), (0.75, 0.5), (0.75, 0.5)]
    rows = [(g, i, x, y) for g, p in sites.items() for i, (x, y) in enumerate(p)]
    cells = {}
    for r in voronoi.voronoi(spark.createDataFrame(rows, "g string, id int, x double, y double"), "g", "id", (0, 0, 1, 1), most).collect():
        cells.setdefault((r["g"], r["id"]), {})[r["seq"]] = (r["x"], r["y"])
    for g, p in sites.items():
        own = {i: [c[k] for k in range(len(c))] for (h, i), c in cells.items() if h == g}
        assert sum(area(c) for c in own.values()) == pytest.approx(1.0)
        for _ in range(200):
            at = p[rng.randrange(len(p))] if rng.random() < 0.5 else (0.5, 0.5)
            q = (min(1, max(0, at[0] + rng.gauss(0, 0.001 if g == "cluster" else 0.3))), min(1, max(0, at[1] + rng.gauss(0, 0.001 if g == "cluster" else 0.3))))
            best = min(range(len(p)), key=lambda i: (math.dist(p[i], q), i))
            inside = lambda c: all((b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) >= -1e-12 for a, b in zip(c, c[1:] + c[:1]))  # noqa: B023, E731
            assert inside(own[best])
    assert ("pair", 2) not in cells


def test_nothing(spark):
    assert voronoi.voronoi(spark.createDataFrame([], "g int, id int, x double, y double"), "g", "id", (0, 0, 1, 1)).count() == 0


def test_holders_meet_only_the_cells_around_them(spark):
    rng = random.Random(5)
    sites = [(g, 100 * g + i, rng.gauss(0, 0.1), rng.gauss(0, 0.1)) for g in (0, 1) for i in range(100)]
    probes = [(k, k % 3, rng.gauss(0, 0.15), rng.gauss(0, 0.15)) for k in range(120)] + [(500, 0, 5.0, 5.0), (501, 1, None, 0.0)]
    cells = voronoi.voronoi(spark.createDataFrame(sites, "g int, id int, x double, y double"), "g", "id", (-1, -1, 1, 1))
    found = voronoi.holders(cells, spark.createDataFrame(probes, "k int, g int, px double, py double"), "g", "id", "k")
    wanted = {k: min((math.dist((x, y), s[2:]), s[1]) for s in sites if s[0] == g)[1] for k, g, x, y in probes[:120] if g < 2}
    assert {r["k"]: r["id"] for r in found.collect()} == wanted
    nothing = spark.createDataFrame([], "g int, id int, seq int, x double, y double")
    assert voronoi.holders(nothing, spark.createDataFrame(probes, "k int, g int, px double, py double"), "g", "id", "k").count() == 0
