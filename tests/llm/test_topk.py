"""Exact top-k search against all products."""

import math
import random

import duckdb
import numpy as np
import pytest
from llm import cases
from pyspark.sql import functions as F

from millrace.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def wanted(rows, k=5, every=50):
    whole = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v]))
    hold = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    out = []
    for a, (i, q) in enumerate(whole):
        if i is not None and i % every == 0:
            found = sorted((-hold(sum(x * y for x, y in zip(q, v))), j is None, j or 0) for b, (j, v) in enumerate(whole) if a != b)
            out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def check(spark, rows, tmp_path, sql=True):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    df = df.withColumns({c: F.lit(7) for c in ("row", "n", "v", "d", "cell", "floor", "score", "rank", "times")})
    folder = cases.saved(df.repartition(3), tmp_path, "embeddings")
    found = sorted(map(tuple, topk.op11_exact_topk(spark, folder).collect()), key=repr)
    assert found == wanted(rows)
    if sql:
        db = duckdb.connect()
        db.sql(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet/*.parquet')")
        assert sorted(db.sql(topk.OP11_SQL).fetchall(), key=repr) == found


def test_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    vector = lambda n=4: [rng.choice([-1.0, 0.5, 0.25, 1.0]) for _ in range(n)]
    rows = [(i, vector()) for i in range(0, 320)]
    rows += [(400 + i, vector(rng.choice([0, 1, 3, 9]))) for i in range(60)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (50, vector()), (7, rows[7][1]), (None, vector()), (None, [1.0] * 4), (None, [1.0] * 4), (-50, vector())]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")]), (1150, [1.0, float("-inf")]), (1200, [])]
    check(spark, rows, tmp_path)


def test_clusters_are_eliminated(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.02 * rng.normal(size=16)).tolist()) for i in range(1500)]
    check(spark, rows, tmp_path)


@pytest.mark.parametrize("size", [30.0, 1e5, 1e7, 1e14, 1e300])
def test_large_components(spark, tmp_path, size):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * (size if i % 3 else 1.0)).tolist()) for i in range(130)]
    if size == 1e300:
        rows = [(i, [min(max(x, -(2.0**54)), 2.0**54) for x in v]) for i, v in rows]
    check(spark, rows, tmp_path, sql=size < 1e7)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(None, [1.0]), (1, [2.0])], [(0, [1.0]), (100, [0.0])]])
def test_few_rows(spark, tmp_path, rows):
    check(spark, rows, tmp_path)


def test_bounds_stop_the_walk():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 50
    x = np.floor(centres[np.arange(4000) % 40] + rng.normal(size=(4000, 8))).astype(np.int64)
    pivots = np.vstack([np.zeros((1, 8), np.int64), x[topk.far_apart(x[:500], 24)]])
    import pyarrow as pa

    d = topk.distances(x, pivots)
    table = pa.table({"row": np.arange(4000), "vec_id": np.arange(4000), "n": np.ones(4000, np.int64), "v": list(x), "d": list(d)})
    block, seen = topk.Block(table, pivots, 5), []
    walk = block._walk
    block._walk = lambda row, order, upper, score, floor: walk(row, order, upper, lambda at: seen.append(len(at)) or score(at), floor)
    for i, at, scores, _ in block.search(np.arange(40), x[:40], d[:40], np.full(40, topk.LIMIT.min)):
        all_scores = x @ x[i]
        all_scores[i] = -(10**12)
        assert at.tolist() == np.lexsort((np.arange(4000), -all_scores))[:5].tolist()
    assert sum(seen) < 40 * 4000 / 5
