"""Prefix scans against the same sums in plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(k, rng.choice(["a", "a", "a", "b", None]), rng.randrange(3), rng.choice([1.5, -2.0, None])) for k in range(4000)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k long, g string, v int, w double").repartition(7), sorted(data)


def test_running_sums(rows):
    df, data = rows
    found = sorted((r["k"], r["s"], r["t"]) for r in scans.running_sums(df, {"s": F.col("v").cast("long"), "t": F.col("w")}, ["k"]).collect())
    s = list(itertools.accumulate(r[2] for r in data))
    t = list(itertools.accumulate(r[3] or 0.0 for r in data))
    assert found == [(r[0], a, b) for r, a, b in zip(data, s, t)]


def test_numbers_within_groups(rows):
    df, data = rows
    found = {r["k"]: r["number"] for r in scans.numbered(df, ["k"], ["g"]).collect()}
    seen = {}
    for k, g, *_ in data:
        seen[g] = seen.get(g, 0) + 1
        assert found[k] == seen[g]


def test_one_group_is_not_one_task(spark, rows, request):
    df, _ = rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    one = df.withColumn("g", F.lit("x"))
    found = scans.numbered(one, ["k"], ["g"])
    sizes = [n for n in found.groupBy(F.spark_partition_id()).count().toPandas()["count"]]
    assert max(sizes) < 2500 and sorted(r["number"] for r in found.collect()) == list(range(1, 4001))


def test_equal_rows_are_spread(spark):
    same = spark.range(3000).select(F.lit(1).alias("k"))
    assert sorted(r["number"] for r in scans.numbered(same, ["k"]).collect()) == list(range(1, 3001))


def test_runs(rows):
    df, data = rows
    plan = scans.runs(df, ["g"], ["k"])
    found = {r["k"]: r["run"] for r in plan.collect()}
    run, last = 0, ()
    for k, g, *_ in data:
        run += (g,) != last
        last = (g,)
        assert found[k] == run
    text = plan._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in text.splitlines() if "Window " in line]
    assert windows and all(scans.PART in line for line in windows)


def test_empty(spark):
    nothing = spark.createDataFrame([], "k long, g string")
    assert scans.runs(nothing, ["g"], ["k"]).count() == scans.numbered(nothing, ["k"], ["g"]).count() == 0
