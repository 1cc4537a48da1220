"""Databases, JSON feeds, transit tables and projection texts."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ends of street names and their short forms.
SUFFIXES = {
    "Street": "St",
    "Avenue": "Ave",
    "Place": "Pl",
    "Boulevard": "Blvd",
    "Road": "Rd",
    "Drive": "Dr",
    "Park": "Pk",
    "Crescent": "Cres",
    "Gardens": "Gdns",
    "Circle": "Crcl",
}
SIDES = {"East": "E", "West": "W", "North": "N", "South": "S"}


def read_query(spark: SparkSession, url: str, query: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of a query in a database: filters and columns that follow are pushed into it."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**(options or {})).load()


def read_table(spark: SparkSession, url: str, table: str, limit: int | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    df = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {})).load()
    return df.limit(limit) if limit is not None else df


def write_table(df: DataFrame, url: str, table: str, drop: bool = False, created_at: bool = False, options: Mapping[str, str] | None = None) -> None:
    out = df.withColumn("created_at", F.current_timestamp()) if created_at else df
    out.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", 100).options(**(options or {})).mode("overwrite" if drop else "append").save()


def has(spark: SparkSession, table: str, column: str | None = None) -> bool:
    """Whether the catalog has the table, or its column."""
    return spark.catalog.tableExists(table) and (column is None or column in spark.table(table).columns)


def read_records(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The objects in one array of JSON documents, a row each; numbers that are written as texts become numbers."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")
    texts = [n for n, t in rows.dtypes if t == "string"]
    if not texts:
        return rows
    number = r"^[+-]?[0-9]+(\.[0-9]+)?$"
    seen = rows.agg(*[f(F.col(c)).alias(f"{k}_{i}") for i, c in enumerate(texts) for k, f in (("all", lambda v: F.every(v.rlike(number))), ("dot", lambda v: F.some(v.contains("."))))]).first()
    kinds = {c: "double" if seen[f"dot_{i}"] else "long" for i, c in enumerate(texts) if seen[f"all_{i}"]}
    return rows.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def short_address(address: Column) -> Column:
    """Street endings and sides in their short forms, without full stops and remarks in brackets."""
    out = F.regexp_replace(F.regexp_replace(address, r"\s*\([^)]*\)", ""), r"\.", "")
    sides = "|".join(SIDES)
    for long, short in SUFFIXES.items():
        out = F.regexp_replace(out, rf"\b{long}(?=( ({sides}|[EWNS]))?$)", short)
    for long, short in SIDES.items():
        out = F.regexp_replace(out, rf"\b{long}$", short)
    return F.trim(F.regexp_replace(out, r" +", " "))


def read_transit(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a transit feed (stops, routes, trips, stop_times, ...), each a CSV with a header."""
    return {n: spark.read.option("header", True).option("escape", '"').csv(f"{folder}/{n}.txt") for n in names}


def parse_wkt(text: str) -> list:
    """A projection text as nested lists: [name, values...]."""
    flat = re.sub(r"\s*([,\[\]])\s*", r"\1", text.replace("\n", " ").strip())
    return json.loads("[" + re.sub(r'(^|,)(\w+)\[', lambda m: f'{m[1]}["{m[2]}",', flat) + "]")[0]
