"""Mergeable quantile sketches as counts of logarithmic buckets.

A positive value falls in bucket ceil(log(value) / log(GAMMA)), others in one bucket of their own; a sketch is the
count of each bucket, so sketches merge by addition, in any order, with the same result. A quantile is off by a
relative error of (GAMMA - 1) / (GAMMA + 1) at most: half a percent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAMMA = 1.01
#: The bucket of zero and less.
ZERO = -(1 << 30)


def bucket(value: Column) -> Column:
    return F.when(value > 0, F.ceil(F.log(value) / math.log(GAMMA)).cast("int")).otherwise(F.lit(ZERO))


def middle(found: Column) -> Column:
    return F.when(found > ZERO, F.pow(F.lit(GAMMA), found) * (2 / (1 + GAMMA))).otherwise(F.lit(0.0))


def sketch(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys..., metric, bucket, n) over all rows; null values are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")
    rows = df.select(*keys, each).where("x.value is not null")
    return rows.groupBy(*keys, F.col("x.metric").alias("metric"), bucket(F.col("x.value")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches added up over fewer keys."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """(keys..., metric, total, one column for each of ``ranks``)."""
    by = Window.partitionBy(*keys, "metric")
    ranked = sketches.withColumn("up_to", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    first = [middle(F.min(F.when(F.col("up_to") >= F.lit(r) * F.col("total"), F.col("bucket")))).alias(name) for name, r in ranks.items()]
    return ranked.groupBy(*keys, "metric").agg(F.max("total").alias("total"), *first)
