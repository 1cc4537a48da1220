"""Edges on the tree of slabs: all that meet are found, and spikes that share a centre are not paired all with all."""

import numpy as np

from millrace.operators import slabs


def spikes(spark, seed, n):
    g = np.random.default_rng(seed)
    angle, far = np.sort(g.uniform(-np.pi, np.pi, n)), g.uniform(0.01, 1, n)
    x, y = np.round(far * np.cos(angle), 6), np.round(far * np.sin(angle), 6)
    rows = [(seed, seed * n + i, float(x[i]), float(y[i]), float(x[(i + 1) % n]), float(y[(i + 1) % n])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "ring long, e long, px double, py double, qx double, qy double")


def test_edges_that_meet(spark):
    n = 1500
    (ra, a), (rb, b) = spikes(spark, 1, n), spikes(spark, 2, n)
    a.cache(), b.cache()
    found = {tuple(r) for r in slabs.meeting(a, b).collect()}
    p, q = (np.array([r[2:] for r in rows]) for rows in (ra, rb))
    side = lambda s, x, y: (s[:, 2:3] - s[:, 0:1]) * (y - s[:, 1:2]) - (s[:, 3:4] - s[:, 1:2]) * (x - s[:, 0:1])
    across = lambda s, r: side(s, r[None, :, 0], r[None, :, 1]) * side(s, r[None, :, 2], r[None, :, 3]) <= 0
    met = {(ra[i][1], rb[j][1]) for i, j in zip(*np.nonzero(across(p, q) & across(q, p).T))}
    assert len(met) > n // 2 and met <= found
    assert len(found) < slabs.ENDS_A_SLAB * n  # a grid pairs some n * n / 4 of them
    assert slabs.Slabs(a).dealt(a).count() < 4 * n * np.log2(n)


def test_heights_at_ends():
    g = np.random.default_rng(5)
    px, py, qx, qy = np.round(g.uniform(-1, 1, (4, 5000)), 6)
    assert np.array_equal(slabs.height(qx, px, py, qx, qy), qy) and np.array_equal(slabs.height(px, px, py, qx, qy), py)
