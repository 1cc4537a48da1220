"""Chains and cycles of any length in a logarithmic number of rounds."""

import random

from millrace.operators import links, sequences


def test_street_of_many_segments(spark, monkeypatch):
    rounds = []
    twice = links._twice_as_far
    monkeypatch.setattr(links, "_twice_as_far", lambda *a: rounds.append(1) or twice(*a))
    n, rng = 5000, random.Random(1)
    names = list(range(n + 1))
    rng.shuffle(names)
    rows = [("main", names[k], names[k + 1], 0.5) for k in range(n)] + [("side", 1, 2, 1.0), (None, 3, 4, 1.0)]
    found = sequences.chain_segments(spark.createDataFrame(rows, "street string, from_node long, to_node long, length double"), spark.createDataFrame([("main", names[2000]), ("side", 2)], "street string, node long")).collect()
    assert len(rounds) < 2 * 20
    assert {(r["node"], r["step"], r["along"]) for r in found if r["street"] == "main"} == {(names[k], k - 2000, (k - 2000) / 2) for k in range(n + 1)}
    assert {(r["node"], r["step"]) for r in found if r["street"] == "side"} == {(2, 0), (1, -1)} and len(found) == n + 3


def test_closed_and_branching_streets(spark):
    rows = [("ring", k, (k + 1) % 6, 1.0) for k in range(6)] + [("tail", a, b, 1.0) for a, b in ((0, 1), (1, 2), (2, 3), (3, 1), (9, 0), (8, 0), (3, 8))] + [("fork", 1, 5, 2.0), ("fork", 1, 4, 3.0), ("fork", 1, 4, 1.0)]
    start = [("ring", 2), ("tail", 0), ("fork", 1), ("nowhere", 7)]
    found = sequences.chain_segments(spark.createDataFrame(rows, "street string, from_node long, to_node long, length double"), spark.createDataFrame(start, "street string, node long")).collect()
    of = lambda s: sorted((r["step"], r["node"], r["along"]) for r in found if r["street"] == s)
    assert of("ring") == [(k, (2 + k) % 6, float(k)) for k in range(6)]
    assert of("tail") == [(-1, 8, -1.0), (0, 0, 0.0), (1, 1, 1.0), (2, 2, 2.0), (3, 3, 3.0)]
    assert of("fork") == [(0, 1, 0.0), (1, 4, 1.0)] and of("nowhere") == [(0, 7, 0.0)]


def test_cycles(spark):
    rng = random.Random(2)
    ids = list(range(1000))
    rng.shuffle(ids)
    cycles = [ids[:1], ids[1:3], ids[3:40], ids[40:]]
    rows = [(c[k], c[(k + 1) % len(c)]) for c in cycles for k in range(len(c))]
    found = {r["node"]: (r["start"], r["step"]) for r in links.rank_cycles(spark.createDataFrame(rows, "node long, next long")).collect()}
    wanted = {}
    for c in cycles:
        at = c.index(min(c))
        wanted |= {node: (min(c), k) for k, node in enumerate(c[at:] + c[:at])}
    assert found == wanted
    assert links.rank_cycles(spark.createDataFrame([], "node long, next long")).count() == 0
