"""Triangles of shapes as a plan: holes, islands, upright edges, a mountain over one edge, spikes around a centre."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import outlines, rings, scans, shapes
from millrace.plans import catalogue

SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]


def box(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]


def test_shapes(spark, monkeypatch):
    monkeypatch.setattr(rings, "tessellate", None)  # no shape is one group
    g = np.random.default_rng(3)
    angle, far = np.sort(g.uniform(-np.pi, np.pi, 400)), g.uniform(0.01, 1, 400)
    spikes = list(zip(np.round(far * np.cos(angle), 6), np.round(far * np.sin(angle), 6)))
    given = {
        "square": [SQUARE + SQUARE[:1]],
        "hole": [SQUARE, box(0.25, 0.25, 0.5)],
        "island": [box(0, 0, 9), box(1, 1, 7), box(2, 2, 5), box(3, 3, 1)],
        "ell": [[(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]],
        "comb": [[(0, 0), (8, 0), (8, 2)] + [(8 - k / 2, 1 + k % 2) for k in range(1, 16)] + [(0, 1)]],
        "spikes": [spikes],
        "line": [[(0, 0), (1, 1)]],
    }
    rows = [(s, p, i, float(x), float(y)) for s, parts in given.items() for p, ring in enumerate(parts) for i, (x, y) in enumerate(ring)]
    t = shapes.tessellate(spark.createDataFrame(rows, "s string, p int, o int, x double, y double"), "s", "p", "o").cache()
    found = {}
    for r in t.collect():
        found.setdefault((r["s"], r["triangle"]), {})[r["corner"]] = (r["x"], r["y"])
    sizes = {}
    for (s, _), c in found.items():
        sizes.setdefault(s, []).append(rings.area([c[0], c[1], c[2]]))
    vertices = {s: sum(len(set(p)) for p in parts) for s, parts in given.items()}
    assert set(sizes) == set(given) - {"line"}
    for s, n in sizes.items():
        areas = [abs(rings.area(p)) for p in given[s]]
        assert min(n) > 0 and sum(n) == pytest.approx(sum(a * (-1) ** k for k, a in enumerate(areas)))
    assert len(sizes["spikes"]) == vertices["spikes"] - 2 and len(sizes["hole"]) == 8
    edges = outlines.dissolve(t, ["s"], "triangle", "corner").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in edges} == {s: vertices[s] for s in sizes}


def test_mountains_are_cut_once(spark, monkeypatch):
    plans, numbered = [], scans.numbered

    def seen(df, *a, **b):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return numbered(df, *a, **b)

    monkeypatch.setattr(scans, "numbered", seen)
    rows = [("a", 0, i, float(x), float(y)) for i, (x, y) in enumerate(SQUARE)]
    assert shapes.tessellate(spark.createDataFrame(rows, "s string, p int, o int, x double, y double"), "s", "p", "o").count() == 6
    # numbering reads its table twice, once for the ranges
    assert len(plans) == 2 and not any("FlatMapGroups" in p for p in plans)


def test_dissolved_ring_of_one_group_is_in_several_tasks(spark, tmp_path):
    """One label, copies of points, a point without coordinates: the edges of the SQL, and no task that has all of them."""
    g = np.random.default_rng(5)
    xy = g.normal(0, 0.2, (300, 2)).round(6).tolist()
    vectors = xy + xy[:40] + [[0.0, 0.0], None]
    rows = [(i, v, 7) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = catalogue._rings(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        found = catalogue.dissolve_shapes(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(r["count"] for r in sizes) == 340 and max(r["count"] for r in sizes) < 250
    assert max(Counter(r["task"] for r in found).values()) < 250
    con = duckdb.connect()
    con.execute(f"create view embeddings as from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"select grp, edges, px, py, qx, qy from ({catalogue.SQL['dissolve_shapes']})").fetchall()
    assert len(want) == 300 and sorted(want) == sorted(tuple(r)[:6] for r in found)
