"""Generated shapes, points and tiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def circle(spark: SparkSession, n: int = 50, x: float = 0.0, y: float = 0.0, radius: float = 1.0) -> DataFrame:
    """A ring of ``n`` vertices (3 to 10000) as shape_row_id, shape_part_id, seq, x, y."""
    n = max(3, min(10000, n))
    turn = F.col("id") * (2 * math.pi / n)
    return spark.range(n).select(F.lit(0).alias("shape_row_id"), F.lit(0).alias("shape_part_id"), F.col("id").alias("seq"), (x + radius * F.cos(turn)).alias("x"), (y + radius * F.sin(turn)).alias("y"))


def square(spark: SparkSession, x: float = 0.0, y: float = 0.0, half: float = 1.0) -> DataFrame:
    """Four corners, counter-clockwise from the lower left."""
    k = F.col("id")
    return spark.range(4).select(
        F.lit(0).alias("shape_row_id"), F.lit(0).alias("shape_part_id"), k.alias("seq"), F.when(k.isin(1, 2), x + half).otherwise(x - half).alias("x"), F.when(k >= 2, y + half).otherwise(y - half).alias("y")
    )


def random_points(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Points in the unit square; the same for the same seed, however they are partitioned."""
    part = lambda k: F.pmod(F.xxhash64(F.lit(2 * seed + k), "id"), F.lit(1 << 30)) / float(1 << 30)
    return spark.range(n).select(F.col("id").alias("seq"), part(0).alias("x"), part(1).alias("y"))


def tiles(spark: SparkSession, min_x: float, min_y: float, max_x: float, max_y: float, step: float) -> DataFrame:
    """Boxes of ``step`` that cover a rectangle, a row each, to be worked on in parallel."""
    nx, ny = math.ceil((max_x - min_x) / step), math.ceil((max_y - min_y) / step)
    i, j = F.floor(F.col("id") / ny), F.col("id") % ny
    at = lambda low, k: low + k * step
    return spark.range(nx * ny).select(i.cast("int").alias("i"), j.cast("int").alias("j"), at(min_x, i).alias("x0"), at(min_y, j).alias("y0"), at(min_x, i + 1).alias("x1"), at(min_y, j + 1).alias("y1"))


def marker(spark: SparkSession, x: float, y: float, size: float) -> DataFrame:
    """Two crossing strokes as two parts of a line strip."""
    x, y = float(x), float(y)
    rows = [(0, 0, x - size, y), (0, 1, x + size, y), (1, 0, x, y - size), (1, 1, x, y + size)]
    return spark.createDataFrame(rows, "shape_part_id int, seq int, x double, y double")
