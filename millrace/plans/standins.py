"""Layers derived from the relational tables, in Spark and in SQL, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    xy = lambda k, n: F.round(F.col("embedding")[k].cast("double"), 6).alias(n)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("grp"), xy(0, "x"), xy(1, "y"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 86400000000.0
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("shape_row_id"), F.lit(0).alias("shape_part_id"), "event_id", days.alias("x"), F.col("value").alias("y"))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, kind = F.col("ts"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("address_id"),
        (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).alias("date_of_infraction"),
        (F.hour(ts) * 100 + F.minute(ts)).alias("time_of_infraction"),
        F.when(kind == "click", 1).when(kind == "view", 5).when(kind == "purchase", 207).when(kind == "signup", 29).otherwise(9).alias("infraction_code"),
        F.col("value").alias("set_fine_amount"),
        F.when(F.col("event_id") % 3 == 0, "OPP").when(F.col("event_id") % 3 == 1, "OP").otherwise("AT").alias("location1"),
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_address"), F.col("c_nationkey").alias("street_id"), (F.col("c_custkey") % 2).cast("int").alias("side"), F.col("c_acctbal").alias("numeric_address")
    )


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three points of each group."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("row_id", "x", "y"))), 1, 3).alias("p")
    corner = lambda k, a, b: (F.get(F.col("p"), F.lit(k))["x"].alias(a), F.get(F.col("p"), F.lit(k))["y"].alias(b))
    return points(spark, sf_dir).groupBy(F.col("grp").alias("polygon_id")).agg(first).select("polygon_id", *corner(0, "ax", "ay"), *corner(1, "bx", "by"), *corner(2, "cx", "cy"))


SQL = {
    "points": "select vec_id row_id, label grp, round(cast(embedding[1] as double), 6) x, round(cast(embedding[2] as double), 6) y from embeddings",
    "tracks": "select user_id shape_row_id, 0 shape_part_id, event_id, (epoch_us(ts) - 1704067200000000) / 86400000000.0::double x, value y from events",
    "tickets": """select event_id id, user_id address_id, year(ts) * 10000 + month(ts) * 100 + day(ts) date_of_infraction, hour(ts) * 100 + minute(ts) time_of_infraction,
  case event_type when 'click' then 1 when 'view' then 5 when 'purchase' then 207 when 'signup' then 29 else 9 end infraction_code, value set_fine_amount,
  case event_id % 3 when 0 then 'OPP' when 1 then 'OP' else 'AT' end location1 from events""",
    "addresses": "select c_custkey id, c_name full_address, c_nationkey street_id, cast(c_custkey % 2 as int) side, c_acctbal numeric_address from customer",
    "triangles": """select grp polygon_id, max(case when rn = 1 then x end) ax, max(case when rn = 1 then y end) ay, max(case when rn = 2 then x end) bx,
  max(case when rn = 2 then y end) "by", max(case when rn = 3 then x end) cx, max(case when rn = 3 then y end) cy
  from (select grp, x, y, row_number() over (partition by grp order by row_id) rn from points) where rn <= 3 group by grp""",
}


def sql(body: str, *names: str) -> str:
    """``body`` with the named layers as common table expressions."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + " " + body
