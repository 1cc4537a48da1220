"""Parameterised point queries: what is near, and how risky it is to park there."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.aggregates import next_slots

MOST_RANGE = 6.0
HALF_PI = math.pi / 2


def near(points: DataFrame, lat: float, lng: float, reach: float = 2.0) -> DataFrame:
    """Points in the square of ``reach`` thousandths of a degree each way, edges included: a pushed-down filter."""
    r = min(reach, MOST_RANGE) / 1000
    return points.where(F.col("x").between(lng - r, lng + r) & F.col("y").between(lat - r, lat + r))


def side_rows(addresses: DataFrame, least: int = 10) -> DataFrame:
    """A row for each side (opposite first) with more than ``least`` tickets: total, meter, three risks, end points.

    A risk is the meter tickets of the next hours times the weekly windows of that length, two weeks' worth being
    certain; it lies in [0, 1] and the longest one is at least a half.
    """
    c = F.col
    # fixed values: windows of each length in two weeks; the third risk's floor and the share of the radius are below
    windows = ((1, 7 * 24 * 2), (3, 7 * 8 * 2), (6, 7 * 4 * 2))

    def side(name: str, rank: int) -> Column:
        total, meter = c(f"num_{name}_tickets"), c(f"num_{name}_meter_tickets")
        risks = [F.when(meter > 0, F.least(F.lit(1.0), c(f"num_{name}_meter_tickets_within_{h}h") * float(n))).otherwise(0.0) for h, n in windows]
        risks[2] = F.greatest(F.lit(0.5), risks[2])
        turn = c("angle") + (math.pi if rank == 0 else 0.0)
        mid_x, mid_y = c("x") + F.cos(turn) * c("road_width") / 2, c("y") + F.sin(turn) * c("road_width") / 2
        reach_x, reach_y = F.cos(c("angle") + HALF_PI) * c("radius") * 0.8, F.sin(c("angle") + HALF_PI) * c("radius") * 0.8
        return F.struct(
            F.lit(name.upper()).alias("side"), F.lit(rank).alias("rank"), total.alias("total"), meter.alias("total_meter"), *[r.alias(f"risk_{h}h") for r, (h, _) in zip(risks, windows)],
            (mid_x + reach_x).alias("x1"), (mid_y + reach_y).alias("y1"), (mid_x - reach_x).alias("x2"), (mid_y - reach_y).alias("y2"),
        )

    both = addresses.withColumn("s", F.explode(F.array(side("op", 0), side("at", 1))))
    return both.where((c("s.total") > least) | (c("s.total_meter") > least)).select("id", "s.*")


def line_risk(histograms: DataFrame, first_slot: int, codes: list[int], scale: float = 1.0) -> DataFrame:
    """Per line, the counts of the next six half hours over the given codes, as three risks of 1, 2 and 3 hours.

    histograms: geo_id, infraction_code, half_hourly and tomorrow (printable), tickets_all_day.
    """
    ahead = F.transform(F.split(next_slots(F.col("half_hourly"), F.col("tomorrow"), first_slot), ""), lambda x: F.ascii(x) - 32)
    counted = histograms.where(F.col("infraction_code").isin(*codes)).withColumn("n", ahead)
    total = lambda k: F.sum(F.aggregate(F.slice("n", 1, 2 * k), F.lit(0), lambda a, x: a + x))
    risk = lambda k: F.round(F.least(F.lit(1.0), F.try_divide(total(k) * float(48 / (2 * k)) * scale, F.sum("tickets_all_day"))), 6)
    return counted.groupBy("geo_id").agg(*[F.coalesce(risk(k), F.lit(0.0)).alias(f"risk_{k}h") for k in (1, 2, 3)])


def round_up(minute: int) -> int:
    """The half-hour slot to start from: at a quarter to the hour or later, the next hour."""
    hour, rest = divmod(minute, 60)
    return ((hour + 1) % 24) * 2 if rest >= 45 else hour * 2 + (rest >= 30)


def upsert(df: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` in place of those with the same key, and added where there is none."""
    return df.join(rows.select(*on), on, "left_anti").unionByName(rows)


def refresh_key(rows: DataFrame, path: str, key: list[str], *values) -> DataFrame:
    """Works out one key anew in a Parquet table that is partitioned by ``key``, and returns the table.

    Only that key's rows of ``rows`` are computed (its plan gets the filter) and only its partition is written; the other
    partitions keep their files. A key without rows loses its partition.
    """
    spark = rows.sparkSession
    own = rows.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(key, values, strict=True)])).cache()
    try:
        if own.isEmpty():
            folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *(f"{k}={v}" for k, v in zip(key, values))]))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        else:
            own.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path)
    finally:
        own.unpersist()
    return spark.read.schema(rows.schema).parquet(path)
