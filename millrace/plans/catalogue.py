"""Every registered query of the engine's own operators, with its SQL.

Derived decimals are rounded on both sides: six places, sums two.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import cli
from millrace import table as tables
from millrace.functions import projections as P
from millrace.functions import geometry as G
from millrace.functions import scalars as S
from millrace.functions import templates, vectors
from millrace.operators import aggregates as A
from millrace.operators import changes, columns, joins, outlines, overlay, rows, scans, sequences, serving, shapes, spectra, voronoi
from millrace.plans.standins import addresses, points, sql, table, tickets, tracks, triangles
from millrace.plans.session import shared_folder, stored
from millrace.sources import blockfile, delimited, feeds, files, generate, shapefile, single, writers
from millrace.streaming import operators as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None, *layers: str):
    """Registers the decorated function by its name, with its SQL (over the named layers) if it has one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if text:
            SQL[fn.__name__] = (sql(text, *layers) if layers else text).replace(") , ", "), ")
        return fn

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


def _shown(df: DataFrame, *names: str) -> DataFrame:
    """Missing integers as -1, as in the SQL."""
    return df.withColumns({n: F.coalesce(n, F.lit(-1)) for n in names})


# Filters


@query("select * from orders where o_custkey in (1, 7, 42, 99)")
def filter_int_in(spark, d):
    return rows.filter_equal(table(spark, d, "orders"), "o_custkey", [1, 7, 42, 99])


@query("select o_orderkey, o_orderstatus from orders where o_custkey not in (1, 7, 42, 99)")
def filter_not_in(spark, d):
    return rows.filter_equal(table(spark, d, "orders"), "o_custkey", [1, 7, 42, 99], keep=False).select("o_orderkey", "o_orderstatus")


@query("select * from lineitem where abs(l_discount - 0.05) < 1e-6")
def filter_float_eps(spark, d):
    return rows.filter_equal(table(spark, d, "lineitem"), "l_discount", [0.05])


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def filter_string(spark, d):
    return rows.filter_equal(table(spark, d, "customer"), "c_mktsegment", ["BUILDING"]).select("c_custkey", "c_name")


@query("select * from points where x between -0.1 and 0.1 and y between -0.2 and 0.2", "points")
def filter_bbox(spark, d):
    return rows.filter_bbox(points(spark, d), -0.1, 0.1, -0.2, 0.2)


@query(
    "select p.* from points p, (select min(x) a, max(x) b, min(y) c, max(y) d from points where grp = 3) q where p.x > a and p.x < b and p.y > c and p.y < d", "points"
)
def reduce_by_bbox(spark, d):
    p = points(spark, d)
    return rows.filter_bbox_of(p, p.where("grp = 3"))


@query("select c_custkey, a, b from (select c_custkey, c_acctbal a, c_nationkey - 20 b from customer) where a > 0 or b > 0")
def filter_any_positive(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), (F.col("c_nationkey") - 20).alias("b"))
    return rows.filter_any_positive(c, "a", "b")


_GREEDY = """, recursive_thin as (
  select shape_row_id, event_id, x, y, rn, x lx, y ly, true keep from numbered where rn = 1
  union all
  select n.shape_row_id, n.event_id, n.x, n.y, n.rn, case when abs(n.x - t.lx) < 2 and abs(n.y - t.ly) < 20 * 2 then t.lx else n.x end,
    case when abs(n.x - t.lx) < 2 and abs(n.y - t.ly) < 20 * 2 then t.ly else n.y end, not (abs(n.x - t.lx) < 2 and abs(n.y - t.ly) < 20 * 2)
  from numbered n join recursive_thin t on n.shape_row_id = t.shape_row_id and n.rn = t.rn + 1
) select shape_row_id, event_id from recursive_thin where keep"""


@query()
def greedy_distance(spark, d):
    parts = tables.runs_to_arrays(tracks(spark, d), ["shape_row_id"], "x", ["y", "event_id"])
    return parts.select("shape_row_id", F.explode(rows.thin(F.col("points"), 2.0, tall=40.0)).alias("p")).select("shape_row_id", "p.event_id")


SQL["greedy_distance"] = (
    sql("", "tracks").rstrip().replace("with tracks", "with recursive tracks", 1)
    + ", numbered as (select *, row_number() over (partition by shape_row_id order by x) rn from tracks)"
    + _GREEDY
)


@query("select c_custkey from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 2)")
def anti_join(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return rows.without(table(spark, d, "customer"), n, ["c_nationkey"]).select("c_custkey")


# Columns and scalars


@query("select p_partkey, cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) brand, p_size from part")
def columns_atoi(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.concat(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("abc")).alias("brand"), "p_size", "p_type")
    return columns.edit_columns(t, remove=["p_type"], to_int=["brand"])


@query("select event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) secs from events")
def int_from_time(spark, d):
    t = table(spark, d, "events").select("event_id", F.date_format("ts", "H:mm:ss").alias("secs"))
    return columns.edit_columns(t, to_seconds=["secs"])


@query("select p_partkey, p_brand || ' ' || p_type || ' ' || p_size label from part")
def strcat(spark, d):
    return columns.concat_text(table(spark, d, "part"), ["p_brand", "p_type", "p_size"], "label").select("p_partkey", "label")


@query("select c_custkey, c_name || '.' c_name from customer")
def trim_whitespace(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(".   ")).alias("c_name"))
    return columns.trim_spaces(t, "c_name")


@query("select row_id, round((x - a) / (b - a) * 10, 6) x from points, (select min(x) a, max(x) b from points)", "points")
def normalize(spark, d):
    return columns.normalize(points(spark, d), ["x"], 10.0).select("row_id", _r("x").alias("x"))


@query("select row_id, round(100 + (x - a) / (b - a) * 100, 6) x, round(50 + (y - c) / (e - c) * -50, 6) y from points, (select min(x) a, max(x) b, min(y) c, max(y) e from points)", "points")
def bounds_rescale(spark, d):
    return columns.rescale_bounds(points(spark, d), 100, 50, 200, 0).select("row_id", _r("x").alias("x"), _r("y").alias("y"))


@query("select row_id, round((x + 1) * 3, 6) x, round((y - 2) * 4, 6) y from points", "points")
def scale_offset(spark, d):
    return columns.transform(points(spark, d), {"x": 1.0, "y": -2.0}, {"x": 3.0, "y": 4.0}).select("row_id", _r("x").alias("x"), _r("y").alias("y"))


@query("select id, dayofweek(strptime(cast(date_of_infraction as varchar), '%Y%m%d')) sunday, isodow(strptime(cast(date_of_infraction as varchar), '%Y%m%d')) - 1 monday from tickets", "tickets")
def add_wday(spark, d):
    c = F.col("date_of_infraction")
    return tickets(spark, d).select("id", S.weekday(c).cast("long").alias("sunday"), S.weekday(c, "monday").cast("long").alias("monday"))


@query("select id, case when location1 in ('OP', 'OPP') then 1 else 0 end is_opp from tickets", "tickets")
def is_opp(spark, d):
    return tickets(spark, d).select("id", A.is_opposite(F.col("location1")).alias("is_opp"))


_RULES = [(1, "ECONOMY", 1.0, 0.0, 0.0, 1.0), (2, "PROMO", 0.0, 1.0, 0.0, 0.5), (3, "ECONOMY", 0.25, 0.5, 0.75, 1.0)]


@query(
    """select p_partkey, case split_part(p_type, ' ', 1) when 'ECONOMY' then 0.25::double else 0.0 end red, case split_part(p_type, ' ', 1) when 'ECONOMY' then 0.5::double when 'PROMO' then 1.0 else 0.0 end green,
  case split_part(p_type, ' ', 1) when 'ECONOMY' then 0.75::double else 0.0 end blue, case split_part(p_type, ' ', 1) when 'PROMO' then 0.5::double else 1.0 end alpha from part"""
)
def color_rules(spark, d):
    rules = spark.createDataFrame(_RULES, "rule int, kind string, red double, green double, blue double, alpha double")
    t = table(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("kind"))
    return columns.colour_by_rules(t, rules, "kind").drop("kind")


@query("select row_id, round(0.30 * abs(x) + 0.59 * abs(y) + 0.11 * 0.5, 6) red, round(0.30 * abs(x) + 0.59 * abs(y) + 0.11 * 0.5, 6) blue from points", "points")
def grayscale(spark, d):
    t = points(spark, d).select("row_id", F.abs("x").alias("red"), F.abs("y").alias("green"), F.lit(0.5).alias("blue"))
    return columns.grayscale(t).select("row_id", _r("red").alias("red"), _r("blue").alias("blue"))


@query("select row_id, round((x - a) / (b - a), 6) red from points, (select min(x) a, max(x) b from points)", "points")
def color_from_number(spark, d):
    return columns.colour_by_number(points(spark, d), "x").select("row_id", _r("red").alias("red"))


@query("select id, round(least(1.0, 0.8 * (wday_1 * n / t) + 0.2), 6) alpha from (select address_id id, count(*) filter (dayofweek(strptime(cast(date_of_infraction as varchar), '%Y%m%d')) = 1) wday_1 from tickets group by 1), (select count(distinct address_id) n, 10000::double t from tickets)", "tickets")
def color_by_wday(spark, d):
    t = A.totals_by_weekday(tickets(spark, d), "address_id").withColumnRenamed("address_id", "id")
    return columns.colour_by_activity(t, "wday_1", 10000).select("id", _r("alpha").alias("alpha"))


_HAVERSINE = "2 * 6372797.560856 * asin(least(1.0, sqrt(pow(sin(radians(y * 10 - 43.6) / 2), 2) + cos(radians(43.6)) * cos(radians(y * 10)) * pow(sin(radians(x * 10 + 79.4) / 2), 2))))"


@query(f"select row_id, round({_HAVERSINE} / 1000, 3) km, round(sqrt(x * x + y * y), 6) planar from points", "points")
def distances(spark, d):
    c = F.col
    km = S.haversine(F.lit(-79.4), F.lit(43.6), c("x") * 10, c("y") * 10) / 1000
    return points(spark, d).select("row_id", _r(km, 3).alias("km"), _r(S.planar(F.lit(0.0), F.lit(0.0), c("x"), c("y"))).alias("planar"))


@query("select row_id, round(cos(radians(y * 100)) * cos(radians(x * 300)), 6) px, round(sin(radians(y * 100)), 6) py, round(cos(radians(y * 100)) * sin(radians(x * 300)), 6) pz from points", "points")
def to_planet(spark, d):
    x, y, z = S.unit_sphere(F.col("x") * 300, F.col("y") * 100)
    return points(spark, d).select("row_id", _r(x).alias("px"), _r(y).alias("py"), _r(z).alias("pz"))


def _forward_sql(lon: str, lat: str, zone_meridian: str) -> str:
    """The forward series over wgs84 in SQL, for a northern point."""
    e = P.Grid.of("wgs84").ecc
    q = e / (1 - e)
    m0, m2, m4, m6 = P.Grid.of("wgs84").arc()
    return f"""select row_id, round(0.9996 * n * a * (1 + (1 - t + c) * a * a / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {q}) * a * a * a * a / 120) + 500000.0, 3) easting,
  round(0.9996 * (m + n * tan(phi) * a * a * (0.5 + (5 - t + 9 * c + 4 * c * c) * a * a / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {q}) * a * a * a * a / 720)), 3) northing
  from (select row_id, phi, 6378137.0 / sqrt(1 - {e} * sin(phi) * sin(phi)) n, tan(phi) * tan(phi) t, {q} * cos(phi) * cos(phi) c, cos(phi) * radians({lon} - ({zone_meridian})) a,
    6378137.0 * ({m0} * phi - {m2} * sin(2 * phi) + {m4} * sin(4 * phi) - {m6} * sin(6 * phi)) m
  from (select row_id, x, y, radians({lat}) phi from points))"""


@query(_forward_sql("(-81 + x)", "(43.5 + y)", "-81"), "points")
def latlon_to_utm(spark, d):
    e, n, _ = P.from_lon_lat(F.col("x") - 81, F.col("y") + 43.5, P.Grid.of("wgs84"), F.lit(17))
    return points(spark, d).select("row_id", _r(e, 3).alias("easting"), _r(n, 3).alias("northing"))


@query("select row_id, round(x - 81, 6) lon, round(y + 43.5, 6) lat from points", "points")
def utm_to_latlon(spark, d):
    grid = P.Grid.of("wgs84")
    e, n, z = P.from_lon_lat(F.col("x") - 81, F.col("y") + 43.5, grid, F.lit(17))
    lon, lat = P.to_lon_lat(F.col("e"), F.col("n"), F.lit(17), grid)
    return points(spark, d).select("row_id", e.alias("e"), n.alias("n")).select("row_id", _r(lon).alias("lon"), _r(lat).alias("lat"))


@query("select row_id, round(x - 79.5, 6) lon, round(y + 43.5, 6) lat from points", "points")
def mtm_round_trip(spark, d):
    grid = P.Grid.of("nad83", mtm=True)
    e, n, z = P.from_lon_lat(F.col("x") - 79.5, F.col("y") + 43.5, grid, F.lit(10))
    lon, lat = P.to_lon_lat(F.col("e"), F.col("n"), F.lit(10), grid)
    return points(spark, d).select("row_id", e.alias("e"), n.alias("n")).select("row_id", _r(lon).alias("lon"), _r(lat).alias("lat"))


@query("select c_custkey, dense_rank() over (order by c_nationkey) nation from customer")
def reset_ids(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return columns.renumber(t, "nation")


@query("select n_nationkey, round(coalesce(m / s, 1.0), 6) red, round(coalesce(m / s, 0.0), 6) green from nation left join (select s_nationkey, max(s_acctbal) m from supplier group by 1) on n_nationkey = s_nationkey, (select max(s_acctbal) - min(s_acctbal) s from supplier)")
def color_from_cost(spark, d):
    costs = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_acctbal")
    return columns.colour_by_cost(table(spark, d, "nation").select("n_nationkey"), costs, "n_nationkey", "s_acctbal").select("n_nationkey", _r("red").alias("red"), _r("green").alias("green"))


@query(
    """, own as (select row_id, grp, row_number() over (partition by grp order by row_id) - 1 i, count(*) over (partition by grp) n from points),
  ser as (select c_nationkey % 10 grp, row_number() over (partition by c_nationkey % 10 order by c_custkey) - 1 j, count(*) over (partition by c_nationkey % 10) m, abs(c_acctbal) / 10000 red from customer),
  siz as (select distinct grp, m from ser)
  select own.row_id, round(ser.red, 6) red from own left join siz using (grp) left join ser on ser.grp = own.grp and ser.j = own.i * siz.m // own.n""",
    "points",
)
def color_from_series(spark, d):
    p = points(spark, d)
    series = table(spark, d, "customer").select((F.col("c_nationkey") % 10).alias("grp"), F.col("c_custkey").alias("row_id"), (F.abs("c_acctbal") / 10000).alias("red"), F.lit(0.0).alias("green"), F.lit(0.0).alias("blue"), F.lit(1.0).alias("alpha"))
    return columns.colour_from_series(p.select("grp", "row_id"), series, "grp", "row_id").select("row_id", _r("red").alias("red"))


@query("select c_custkey, trim(replace(replace(c_name, 'Customer#', ''), ' ', '')) || ' Queen St W' address from customer")
def short_addresses(spark, d):
    name = F.regexp_replace("c_name", "Customer#", "")
    return table(spark, d, "customer").select("c_custkey", feeds.short_address(F.concat(F.trim(name), F.lit(" Queen Street West (Parks)"))).alias("address"))


@query("select row_number() over (order by o_totalprice, o_orderkey) place, o_orderkey from orders")
def number_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return tables.number_in_order(o, "o_totalprice", "o_orderkey", name="place").select("place", "o_orderkey")


# Order, sets, duplicates


@query("select * from (select *, row_number() over (partition by o_custkey order by o_orderkey) rn from orders) where rn = 1".replace("select * from (", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from ("))
def unique_first(spark, d):
    return rows.unique_first(table(spark, d, "orders"), "o_custkey", ["o_orderkey"])


@query("select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) rn from orders) where rn = 1")
def unique_last(spark, d):
    return rows.unique_first(table(spark, d, "orders"), "o_custkey", ["o_orderkey"], last=True).select("o_orderkey", "o_custkey")


@query("select c_custkey, c_nationkey from customer order by c_nationkey desc, c_custkey limit 100")
def sort_top(spark, d):
    return rows.top(table(spark, d, "customer").select("c_custkey", "c_nationkey"), 100, F.col("c_nationkey").desc(), "c_custkey")


@query("select n_nationkey k, n_name name from nation union all select s_nationkey, s_name from supplier")
def append_union(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return rows.append(n, table(spark, d, "supplier").select("s_nationkey", "s_name"))


@query("select c_nationkey k from customer union select s_nationkey from supplier")
def union_distinct(spark, d):
    return rows.union_distinct(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select("s_nationkey"))


@query("select c_nationkey k from customer where c_acctbal > 5000 intersect select s_nationkey from supplier where s_acctbal < 0")
def intersect_rows(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").where("s_acctbal < 0").select("s_nationkey"))


@query("select c_custkey k from customer except select o_custkey from orders")
def except_rows(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("select user_id, event_id, ts, sum(new) over (partition by user_id order by ts, event_id) run from (select *, case when event_type is distinct from lag(event_type) over (partition by user_id order by ts, event_id) then 1 else 0 end new from events)".replace("sum(new) over (partition by user_id order by ts, event_id) run", "cast(sum(new) over (partition by user_id order by ts, event_id) as bigint) run"))
def islands(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return tables.islands(e, ["event_type"], ["ts", "event_id"], within=["user_id"]).drop("event_type")


@query("select event_id, cast(sum(new) over (order by ts, event_id) as bigint) run from (select *, case when event_type is distinct from lag(event_type) over (order by ts, event_id) then 1 else 0 end new from events)")
def islands_whole(spark, d):
    """Runs of one type over the whole table, which no task sorts alone."""
    return tables.islands(table(spark, d, "events").select("event_id", "ts", "event_type"), ["event_type"], ["ts", "event_id"]).select("event_id", "run")


@query("select event_id, row_number() over (order by ts, event_id) number, round(sum(value) over (order by ts, event_id rows unbounded preceding), 2) up_to from events")
def running_total(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "value")
    found = scans.running_sums(e, {"number": F.lit(1).cast("long"), "up_to": F.col("value")}, ["ts", "event_id"])
    return found.select("event_id", "number", _r("up_to", 2).alias("up_to"))


# Joins


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")


def _orders(spark, d):
    """Orders by a customer some places on from their own: some have none, and some customers no order."""
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + 10 * (F.col("o_orderkey") % 50)).alias("o_custkey"))


_ON = "(select o_orderkey, o_custkey + 10 * (o_orderkey % 50) o_custkey from orders)"


@query(f"select o_orderkey, o_custkey, coalesce(c_custkey, -1) c_custkey, c_name, coalesce(c_nationkey, -1) c_nationkey from {_ON} left join customer on o_custkey = c_custkey")
def join_left(spark, d):
    return _shown(joins.join_tables(_orders(spark, d), _customers(spark, d), "o_custkey", "c_custkey", "left"), "c_custkey", "c_nationkey")


@query(f"select o_orderkey, o_custkey, c_custkey, c_name, c_nationkey from {_ON} join customer on o_custkey = c_custkey")
def join_inner(spark, d):
    return joins.join_tables(_orders(spark, d), _customers(spark, d), "o_custkey", "c_custkey", "inner")


@query(f"select coalesce(o_orderkey, -1) o_orderkey, coalesce(o_custkey, c_custkey) o_custkey, c_custkey, c_name, c_nationkey from {_ON} right join customer on o_custkey = c_custkey")
def join_right(spark, d):
    return _shown(joins.join_tables(_orders(spark, d), _customers(spark, d), "o_custkey", "c_custkey", "right"), "o_orderkey")


@query(f"select o_orderkey, o_custkey, coalesce(c_custkey, 0) c_custkey, coalesce(c_name, '') c_name, coalesce(c_nationkey, 0) c_nationkey from {_ON} left join customer on o_custkey = c_custkey")
def join_left_zero(spark, d):
    return joins.join_tables(_orders(spark, d), _customers(spark, d), "o_custkey", "c_custkey", "left", zero=True)


@query("select s_suppkey, coalesce(c_custkey, -1) first_customer from supplier left join (select c_nationkey, min(c_custkey) c_custkey from customer group by 1) on s_nationkey = c_nationkey")
def lookup_first_wins(spark, d):
    return joins.lookup(table(spark, d, "supplier"), table(spark, d, "customer"), "s_nationkey", "c_nationkey", {"c_custkey": "first_customer"}, ["c_custkey"]).select("s_suppkey", F.coalesce("first_customer", F.lit(-1)).alias("first_customer"))


@query(
    """select c.c_custkey, coalesce(a.s_suppkey, b.s_suppkey, -1) supplier from customer c
  left join (select 'Customer#' || right('000000000' || s_suppkey, 9) k, s_suppkey from supplier) a on c.c_name = a.k
  left join (select cast(s_nationkey as varchar) k, min(s_suppkey) s_suppkey from supplier group by 1) b on cast(c.c_nationkey as varchar) = b.k"""
)
def lookup_fallback(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("nation_key"))
    found = joins.lookup_fallback(c, s, "c_name", "name", "nation", "s_suppkey", "supplier", ["s_suppkey"], second_left_key="nation_key")
    return found.select("c_custkey", F.coalesce("supplier", F.lit(-1)).alias("supplier"))


@query("select id, address_id from tickets union all select t.id, b.id from tickets t join addresses a on t.address_id = a.id join addresses b on a.street_id = b.street_id and a.side = b.side and floor(a.numeric_address / 500) = floor(b.numeric_address / 500) and a.id <> b.id", "tickets", "addresses")
def self_dup_join(spark, d):
    a = addresses(spark, d).withColumn("shared", F.struct("street_id", "side", F.floor(F.col("numeric_address") / 500).alias("lot")))
    return joins.duplicate_for_shared_key(tickets(spark, d).select("id", "address_id"), a, "id", "shared", "address_id")


_BARY = """select p.row_id, count(t.polygon_id) hits, coalesce({pick}(t.polygon_id), -1) hit from points p left join triangles t
  on ((cx - ax) * (p.y - ay) is not null
  and ((p.x - ax) * ("by" - ay) - (bx - ax) * (p.y - ay)) / ((cx - ax) * ("by" - ay) - (bx - ax) * (cy - ay)) > 0
  and ((cx - ax) * (p.y - ay) - (p.x - ax) * (cy - ay)) / ((cx - ax) * ("by" - ay) - (bx - ax) * (cy - ay)) > 0
  and ((p.x - ax) * ("by" - ay) - (bx - ax) * (p.y - ay)) / ((cx - ax) * ("by" - ay) - (bx - ax) * (cy - ay)) + ((cx - ax) * (p.y - ay) - (p.x - ax) * (cy - ay)) / ((cx - ax) * ("by" - ay) - (bx - ax) * (cy - ay)) < 1)
  group by 1"""


@query(_BARY.format(pick="min"), "points", "triangles")
def point_in_triangle(spark, d):
    return joins.point_in_triangle(points(spark, d), triangles(spark, d), "polygon_id", 0.05, point_id="row_id").select("row_id", "hits", F.coalesce("hit", F.lit(-1)).alias("hit"))


@query(_BARY.format(pick="max"), "points", "triangles")
def point_in_triangle_last(spark, d):
    return joins.point_in_triangle(points(spark, d), triangles(spark, d), "polygon_id", 0.05, last=True, point_id="row_id").select("row_id", "hits", F.coalesce("hit", F.lit(-1)).alias("hit"))


@query("select a.row_id, b.row_id other from points a join points b on abs(a.x - b.x) <= 0.01 and abs(a.y - b.y) <= 0.01", "points")
def range_box(spark, d):
    p = points(spark, d)
    return joins.within_box(p.select("row_id", "x", "y"), p, 0.01, {"row_id": "other", "x": "x2", "y": "y2"}).select("row_id", "other")


_NEAREST = "select row_id, nearest, round(distance, 6) distance from (select a.row_id, b.row_id nearest, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) distance, row_number() over (partition by a.row_id order by sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.row_id) rn from points a join points b on {on}) where rn = 1"


@query(_NEAREST.format(on="a.row_id <> b.row_id"), "points")
def nearest_neighbour(spark, d):
    p = points(spark, d)
    return joins.nearest(p, p, "row_id", "row_id", 0.02, same_layer=True).withColumn("distance", _r("distance"))


@query("select row_id, round(greatest(min(distance), 0.00005), 6) radius from (select a.row_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) distance from points a join points b on a.row_id <> b.row_id) group by 1", "points")
def nn_radius(spark, d):
    p = points(spark, d)
    return joins.nearest(p, p, "row_id", "row_id", 0.02, same_layer=True).select("row_id", _r(F.greatest("distance", F.lit(0.00005))).alias("radius"))


def _segments(spark, d):
    w = Window.partitionBy("grp").orderBy("row_id")
    p = points(spark, d)
    return p.select(F.col("row_id").alias("segment_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 is not null")


@query(
    """, seg as (select * from (select row_id segment_id, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from points window w as (partition by grp order by row_id)) where x2 is not null),
  near as (select p.row_id, p.x, p.y, segment_id, x1, y1, x2, y2, greatest(0.0, least(1.0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) t from points p, seg),
  gap as (select *, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) d from near),
  best as (select * from (select *, row_number() over (partition by row_id order by d, segment_id) rn from gap where d <= 0.05) where rn = 1)
  select p.row_id, coalesce(b.segment_id, -1) segment_id, round(x1 + t * (x2 - x1), 6) snapped_x, round(y1 + t * (y2 - y1), 6) snapped_y, round(d, 6) distance from points p left join best b using (row_id)""",
    "points",
)
def snap_to_segment(spark, d):
    s = joins.snap_to_segments(points(spark, d), _segments(spark, d), "row_id", 0.05, 0.05)
    return s.select("row_id", F.coalesce("segment_id", F.lit(-1)).alias("segment_id"), _r("snapped_x").alias("snapped_x"), _r("snapped_y").alias("snapped_y"), _r("distance").alias("distance"))


SQL["snap_to_segment"] = SQL["snap_to_segment"].replace(") , seg", "), seg")


@query(
    """, c as (select grp line, row_id seq, x x1, y y1, lead(x) over w x2, lead(y) over w y2, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0.0) step from points window w as (partition by grp order by row_id)),
  seg as (select *, sum(step) over (partition by line order by seq) begin from c),
  near as (select p.row_id, p.x, p.y, line, seq, begin, x1, y1, x2, y2, greatest(0.0, least(1.0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) t from points p, seg where x2 is not null),
  gap as (select *, x1 + t * (x2 - x1) fx, y1 + t * (y2 - y1) fy, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) d from near),
  best as (select * from (select *, row_number() over (partition by row_id order by d, line, seq) rn from gap where d <= 0.05) where rn = 1)
  select row_id, line, round(d, 6) distance, round(begin + sqrt(pow(fx - x1, 2) + pow(fy - y1, 2)), 6) along from best""",
    "points",
)
def align_to_lines(spark, d):
    p = points(spark, d)
    lines = p.select(F.col("grp").alias("line"), F.col("row_id").alias("seq"), "x", "y")
    return joins.align_to_lines(p.select("row_id", "x", "y"), lines, "row_id", 0.05, 0.05).select("row_id", "line", _r("distance").alias("distance"), _r("along").alias("along"))


_OVERLAPS = """, st as (select * from (select *, row_number() over (partition by grp order by row_id) rn from points) where rn = 1),
  near as (select st.grp shape, p.grp other, st.x, st.y, p.row_id pl, p.x x2, p.y y2, sqrt(pow(st.x - p.x, 2) + pow(st.y - p.y, 2)) d from st join points p on st.grp <> p.grp and sqrt(pow(st.x - p.x, 2) + pow(st.y - p.y, 2)) < 0.05),
  best as (select * from (select *, row_number() over (partition by shape, other order by d, pl) k from near) where k = 1)"""


@query(_OVERLAPS + " select shape, other, x2, y2 from best", "points")
def overlap_connectors(spark, d):
    return joins.cut_at_overlaps(points(spark, d), "grp", "row_id", 0.05)[1].select("shape", "other", "x2", "y2")


@query(_OVERLAPS + " select p.row_id, p.grp from points p left join (select other, min(pl) e from best group by 1) b on p.grp = b.other where e is null or p.row_id <= e", "points")
def reduce_by_overlap(spark, d):
    return joins.cut_at_overlaps(points(spark, d), "grp", "row_id", 0.05)[0].select("row_id", "grp")


# Aggregates


@query("select l_returnflag as value, count(*) n from lineitem group by 1")
def value_counts(spark, d):
    return A.value_counts(table(spark, d, "lineitem"), "l_returnflag")


@query(
    """select 'l_quantity' as name, min(l_quantity) low, max(l_quantity) high, -1 longest, -1::bigint n_longest from lineitem
  union all select 'l_extendedprice', min(l_extendedprice), max(l_extendedprice), -1, -1 from lineitem
  union all select 'l_linestatus', null, null, max(length(l_linestatus)), count(*) filter (length(l_linestatus) = (select max(length(l_linestatus)) from lineitem)) from lineitem"""
)
def bounds_report(spark, d):
    return _shown(A.bounds_report(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_linestatus")), "longest", "n_longest")


@query("select grp, corner, round(case when corner in (0, 3) then a - (b - a) * 0.05 else b + (b - a) * 0.05 end, 6) x, round(case when corner < 2 then c - (e - c) * 0.05 else e + (e - c) * 0.05 end, 6) y from (select grp, min(x) a, max(x) b, min(y) c, max(y) e from points group by 1), (select unnest([0, 1, 2, 3])::int corner)", "points")
def bbox_polygon(spark, d):
    return A.bbox_polygon(points(spark, d), ["grp"], 0.1).select("grp", "corner", _r("x").alias("x"), _r("y").alias("y"))


def _totals_sql(weekday: int, minute: int) -> str:
    opp, meter = "location1 in ('OP', 'OPP')", "infraction_code in (1, 207, 210, 312)"
    day, at = "dayofweek(strptime(cast(date_of_infraction as varchar), '%Y%m%d'))", "(time_of_infraction // 100 * 60 + time_of_infraction % 100)"
    cols = []
    for side, a in (("at", f"not {opp}"), ("op", opp)):
        for kind, k in (("tickets", f"not {meter}"), ("meter_tickets", meter)):
            cols.append(f"count(*) filter ({a} and {k}) num_{side}_{kind}")
            for h in (1, 3, 6):
                if minute + h * 60 <= 1440:
                    w = f"{day} = {weekday} and {at} > {minute} and {at} < {minute + h * 60}"
                else:
                    w = f"{day} = {(weekday + 1) % 7} and {at} > {minute - 1440} and {at} < {minute - 1440 + h * 60}"
                cols.append(f"count(*) filter ({a} and {k} and {w}) num_{side}_{kind}_within_{h}h")
    names = [c.rpartition(" ")[2] for c in cols]
    return f", t as (select address_id, {', '.join(cols)} from tickets group by 1) select a.*, {', '.join(f'coalesce({n}, 0) {n}' for n in names)} from addresses a left join t on a.id = t.address_id"


@query(_totals_sql(2, 600), "tickets", "addresses")
def ticket_totals(spark, d):
    return A.ticket_totals(addresses(spark, d), tickets(spark, d), 2, 600)


@query(_totals_sql(6, 1290), "tickets", "addresses")
def ticket_lookahead(spark, d):
    return A.ticket_totals(addresses(spark, d), tickets(spark, d), 6, 1290)


@query(
    "select address_id, count(*) n, round(sum(set_fine_amount), 2) fines, " + ", ".join(f"count(*) filter (dayofweek(strptime(cast(date_of_infraction as varchar), '%Y%m%d')) = {k}) wday_{k}" for k in range(7)) + " from tickets group by 1", "tickets"
)
def totals_by_weekday(spark, d):
    return A.totals_by_weekday(tickets(spark, d), "address_id")


@query("select address_id, count(*) filter (location1 = 'AT') num_at, count(*) filter (location1 <> 'AT') num_op from tickets group by 1", "tickets")
def totals_by_side(spark, d):
    return A.totals_by_side(tickets(spark, d), "address_id")


def _hist(spark, d):
    t = tickets(spark, d).withColumns({"is_opp": A.is_opposite(F.col("location1")), "wday": S.weekday(F.col("date_of_infraction")), "geo_id": F.col("address_id") % 20})
    return A.half_hour_histogram(t, ["geo_id", "is_opp", "infraction_code", "wday"])


_SLOTS = """, t as (select address_id % 20 geo_id, case when location1 in ('OP', 'OPP') then 1 else 0 end is_opp, infraction_code, dayofweek(strptime(cast(date_of_infraction as varchar), '%Y%m%d')) wday,
  cast((time_of_infraction // 100 * 60 + time_of_infraction % 100) // 30 as int) slot from tickets),
  g as (select geo_id, is_opp, infraction_code, wday, count(*) tickets_all_day from t group by all),
  c as (select geo_id, is_opp, infraction_code, wday, slot, count(*) n from t group by all),
  h as (select g.geo_id, g.is_opp, g.infraction_code, g.wday, g.tickets_all_day, s.slot, coalesce(c.n, 0) n, max(coalesce(c.n, 0)) over (partition by g.geo_id, g.is_opp, g.infraction_code, g.wday) most
    from g cross join (select unnest(range(48))::int slot) s left join c on c.geo_id = g.geo_id and c.is_opp = g.is_opp and c.infraction_code = g.infraction_code and c.wday = g.wday and c.slot = s.slot),
  p as (select geo_id, is_opp, infraction_code, cast(wday as int) wday, tickets_all_day, string_agg(chr(cast(32 + least(n, 94) as int)), '' order by slot) half_hourly,
    string_agg(substr(' .,-=+*%0#', cast(floor(n / greatest(most, 1) * 9) as int) + 1, 1), '' order by slot) symbols from h group by geo_id, is_opp, infraction_code, wday, tickets_all_day)"""


@query(_SLOTS + " select geo_id, is_opp, infraction_code, wday, tickets_all_day, half_hourly from p", "tickets")
def halfhour_hist(spark, d):
    return _hist(spark, d).select("geo_id", "is_opp", "infraction_code", "wday", "tickets_all_day", A.as_printable(F.col("slots")).alias("half_hourly"))


@query(_SLOTS + " select geo_id, is_opp, infraction_code, wday, symbols from p", "tickets")
def halfhour_symbols(spark, d):
    return _hist(spark, d).select("geo_id", "is_opp", "infraction_code", "wday", A.as_symbols(F.col("slots")).alias("symbols"))


@query(_SLOTS + " select p.geo_id, p.is_opp, p.infraction_code, p.wday, substr(p.half_hourly || coalesce(q.half_hourly, repeat(' ', 48)), 47, 6) ahead from p left join p q on p.geo_id = q.geo_id and p.is_opp = q.is_opp and p.infraction_code = q.infraction_code and q.wday = (p.wday + 1) % 7", "tickets")
def next3h_wrap(spark, d):
    h = _hist(spark, d).withColumn("half_hourly", A.as_printable(F.col("slots"))).drop("slots", "tickets_all_day")
    both = A.with_tomorrow(h, ["geo_id", "is_opp", "infraction_code"])
    return both.select("geo_id", "is_opp", "infraction_code", "wday", A.next_slots(F.col("half_hourly"), F.col("tomorrow"), 46).alias("ahead"))


for _name in ("halfhour_hist", "halfhour_symbols", "next3h_wrap", "ticket_totals", "ticket_lookahead"):
    SQL[_name] = SQL[_name].replace(") , t as", "), t as")


@query("select label, w as window, round(sqrt(avg(v * v)), 6) rms from (select label, v, (row_number() over (partition by label order by vec_id, k) - 1) // 64 w from (select label, vec_id, unnest(range(64)) k, cast(unnest(embedding) as double) v from embeddings)) group by 1, 2")
def rms(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("k", "v")).withColumns({"at": F.struct("vec_id", "k"), "v": F.col("v").cast("double")})
    return A.rms(e, "label", "at", "v", 64).select("label", "window", _r("rms").alias("rms"))


@query("select shape_row_id, count(*) n, round(sum(x), 2) sx from tracks group by 1", "tracks")
def group_shapes(spark, d):
    g = A.group_shapes(tracks(spark, d), "shape_row_id", "event_id")
    return g.select("shape_row_id", F.size("points").cast("long").alias("n"), _r(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"]), 2).alias("sx"))


@query("select n_regionkey, count(*) suppliers, round(avg(s_acctbal), 2) mean, min(s_acctbal) low, max(s_acctbal) high from supplier join nation on s_nationkey = n_nationkey group by 1")
def sql_passthrough(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return spark.sql(
        "select n_regionkey, count(*) suppliers, round(avg(s_acctbal), 2) mean, min(s_acctbal) low, max(s_acctbal) high from {s} join {n} on s_nationkey = n_nationkey group by 1", s=s, n=n
    )


# Sequences


@query("select id, coalesce(lag(id) over w, -1) previous, coalesce(lead(id) over w, -1) as next from addresses window w as (partition by street_id, side order by numeric_address, id)", "addresses")
def neighbour_lag_lead(spark, d):
    return _shown(sequences.neighbours(addresses(spark, d), ["street_id", "side"], ["numeric_address", "id"], "id").select("id", "previous", "next"), "previous", "next")


@query(
    "select event_id, round(sum(step) over (partition by shape_row_id order by x, event_id rows unbounded preceding), 2) along from (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) step from tracks window w as (partition by shape_row_id order by x, event_id))",
    "tracks",
)
def cumulative_distance(spark, d):
    return sequences.running_distance(tracks(spark, d), ["shape_row_id"], ["x", "event_id"]).select("event_id", _r("along", 2).alias("along"))


@query("select event_id, cast(sum(fell) over (partition by shape_row_id order by x, event_id) as bigint) trip from (select *, case when y < lag(y) over (partition by shape_row_id order by x, event_id) then 1 else 0 end fell from tracks)", "tracks")
def trip_split(spark, d):
    return sequences.split_trips(tracks(spark, d), "shape_row_id", ["x", "event_id"], "y").select("event_id", "trip")


@query(
    """, a as (select *, atan2(lead(y) over w - y, lead(x) over w - x) a from tracks window w as (partition by shape_row_id order by x, event_id)),
  b as (select *, coalesce(a, lag(a) over (partition by shape_row_id order by x, event_id), 0) g from a)
  select event_id, round(x + 0.5 * cos(g + pi() / 2), 6) left_x, round(y - 0.5 * sin(g + pi() / 2), 6) right_y from b""",
    "tracks",
)
def offset_polyline(spark, d):
    o = sequences.offset_lines(tracks(spark, d), ["shape_row_id"], ["x", "event_id"], 0.5)
    return o.select("event_id", _r("left_x").alias("left_x"), _r("right_y").alias("right_y"))


SQL["offset_polyline"] = SQL["offset_polyline"].replace(") , a as", "), a as")


@query(
    """, a as (select *, atan2(lead(y) over w - y, lead(x) over w - x) a, case when shape_row_id % 3 = 1 then 1.0 else 0.5 end h from tracks window w as (partition by shape_row_id order by x, event_id)),
  b as (select *, coalesce(a, lag(a) over (partition by shape_row_id order by x, event_id), 0) + pi() / 2 g from a)
  select event_id, round(x + h * cos(g), 6) left_x, round(y + h * sin(g), 6) left_y, round(x - h * cos(g), 6) right_x, round(y - h * sin(g), 6) right_y from b""",
    "tracks",
)
def offset_wide_lines(spark, d):
    """Both sides of lines, twice as far apart for a third of them."""
    half = S.road_width(F.col("shape_row_id") % 3, 0.5, (1,))
    o = sequences.offset_lines(tracks(spark, d), ["shape_row_id"], ["x", "event_id"], half)
    return o.select("event_id", *[_r(n).alias(n) for n in ("left_x", "left_y", "right_x", "right_y")])


SQL["offset_wide_lines"] = SQL["offset_wide_lines"].replace(") , a as", "), a as")


@query("select shape_row_id, round(sum(x * ny - nx * y) / 2, 2) area from (select *, lead(x) over w nx, lead(y) over w ny from tracks window w as (partition by shape_row_id order by x, event_id)) group by 1", "tracks")
def winding_area(spark, d):
    return sequences.signed_area(tracks(spark, d), ["shape_row_id"], ["x", "event_id"]).select("shape_row_id", _r("area", 2).alias("area"))


@query("select event_id, lo + hi - event_id as seq from (select event_id, min(event_id) over (partition by shape_row_id) lo, max(event_id) over (partition by shape_row_id) hi from tracks)", "tracks")
def reverse_ring(spark, d):
    t = tracks(spark, d).withColumn("seq", F.col("event_id"))
    return sequences.orient(t, ["shape_row_id"], "seq", "reverse").select("event_id", "seq")


@query(
    """with recursive o as (
  select user_id street, event_id n, value, lead(event_id) over w nx, lead(value) over w nv, lead(event_id, 2) over w skip, first_value(event_id) over w f
  from events window w as (partition by user_id order by ts, event_id)
), seg as (
  select street, n a, nx b, round(abs(nv - value), 3) len from o where nx is not null
  union all select street, n, skip, 1.5 from o where n % 7 = 0 and skip is not null
  union all select street, n, f, 2.0 from o where nx is null and street % 10 = 0
), f as (select * from seg qualify row_number() over (partition by street, a order by b, len) = 1
), g as (select * from seg qualify row_number() over (partition by street, b order by a, len) = 1
), s as (select street, min(n) node, count(*) most from o group by 1
), ahead(street, node, step, along, most) as (
  select street, node, 0, 0.0::double, most from s
  union all select t.street, b, step + 1, along + len, most from ahead t join f on t.street = f.street and t.node = f.a where step < most
), back(street, node, step, along, most) as (
  select street, node, 0, 0.0::double, most from s
  union all select t.street, a, step + 1, along + len, most from back t join g on t.street = g.street and t.node = g.b where step < most
), fa as (select street, node, min(step) step, arg_min(along, step) along from ahead group by 1, 2
), ba as (select street, node, min(step) step, arg_min(along, step) along from back where step > 0 group by 1, 2
), met as (select street, min(ba.step) met from ba join fa using (street, node) group by 1)
select street, node, cast(step as bigint) step, round(along, 3) along from fa
union all select street, node, cast(-step as bigint), round(-along, 3) from ba left join met using (street) where met is null or step < met"""
)
def chain_streets(spark, d):
    """Each user's events as a street: one after the other, with short cuts, some of them closed; from the first id both ways."""
    w = Window.partitionBy("street").orderBy("ts", "n")
    e = table(spark, d, "events").select(F.col("user_id").alias("street"), F.col("event_id").alias("n"), "value", "ts")
    o = e.select("street", "n", "value", *[F.lead(c, k).over(w).alias(a) for c, k, a in (("n", 1, "nx"), ("value", 1, "nv"), ("n", 2, "skip"))], F.first("n").over(w).alias("f"))
    part = lambda to, length, where: o.where(where).select("street", F.col("n").alias("from_node"), F.col(to).alias("to_node"), length.alias("length"))
    segments = part("nx", _r(F.abs(F.col("nv") - F.col("value")), 3), "nx is not null").union(part("skip", F.lit(1.5), "n % 7 = 0 and skip is not null")).union(part("f", F.lit(2.0), "nx is null and street % 10 = 0"))
    found = sequences.chain_segments(segments, e.groupBy("street").agg(F.min("n").alias("node")))
    return found.withColumn("along", _r("along", 3))


# Shapes


@query(
    """, v as (select shape_row_id s, event_id, x, y, row_number() over (partition by shape_row_id order by x, event_id) i from tracks
), e as (select s, min(i) a, max(i) b from v group by 1
), ring as (select e.*, p.x, p.y from e join v p on p.s = e.s and p.i = e.a join v q on q.s = e.s and q.i = e.b where p.x = q.x and p.y = q.y and b > a + 1
), far as (select v.s, arg_max(i, struct_pack(d := (v.x - ring.x) ** 2 + (v.y - ring.y) ** 2, k := -i)) m from v join ring using (s) group by 1
), chord(s, a, b) as (
  select s, a, b from e where s not in (select s from far)
  union all select s, unnest([a, m]), unnest([m, b]) from e join far using (s)
  union all
  select s, unnest([a, m]), unnest([m, b]) from (
    select c.s, c.a, c.b, arg_max(v.i, struct_pack(g := gap, k := -v.i)) m, max(gap) g from (
      select c.*, v.i, case when (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) > 0
        then abs((q.x - p.x) * (v.y - p.y) - (q.y - p.y) * (v.x - p.x)) / sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))
        else sqrt((v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y)) end gap
      from chord c join v on v.s = c.s and v.i > c.a and v.i < c.b join v p on p.s = c.s and p.i = c.a join v q on q.s = c.s and q.i = c.b) c
    join v using (s, i) group by 1, 2, 3) where g > 5)
select s shape_row_id, event_id from v where (s, i) in (select s, a from chord union select s, b from chord)""".replace("), v as (", "), v as (", 1),
    "tracks",
)
def simplify(spark, d):
    return shapes.simplify(tracks(spark, d).withColumn("seq", F.struct("x", "event_id")), ["shape_row_id"], "seq", 5.0).select("shape_row_id", "event_id")


SQL["simplify"] = SQL["simplify"].replace("with tracks", "with recursive tracks", 1).replace(") , v as", "), v as", 1)


_TURNED = """select event_id, case when {when} then lo + hi - event_id else event_id end as seq from (
  select *, min(event_id) over g lo, max(event_id) over g hi, sum(x * ny - nx * y) over g area from (
    select *, lead(x) over w nx, lead(y) over w ny from tracks window w as (partition by shape_row_id order by event_id)) window g as (partition by shape_row_id))"""


@query(_TURNED.format(when="area < 0"), "tracks")
def turn_clockwise(spark, d):
    """Rings against the clock stay, those with it are turned."""
    return sequences.orient(tracks(spark, d).withColumn("seq", F.col("event_id")), ["shape_row_id"], "seq", "cw").select("event_id", "seq")


@query(_TURNED.format(when="area > 0"), "tracks")
def turn_counter_clockwise(spark, d):
    return sequences.orient(tracks(spark, d).withColumn("seq", F.col("event_id")), ["shape_row_id"], "seq", "ccw").select("event_id", "seq")


@query("select grp, row_id seq from points", "points")
def loop_overlap(spark, d):
    p = points(spark, d).select("grp", F.col("row_id").alias("seq"), "x", "y")
    first = p.groupBy("grp").agg(F.min(F.struct("seq", "x", "y")).alias("f"), F.max("seq").alias("m")).select("grp", (F.col("m") + 1).alias("seq"), "f.x", "f.y")
    return shapes.cut_overlap(p.union(first), ["grp"], "seq", 1e-6).select("grp", "seq")


def _rings(spark, d):
    """A star-shaped ring per group: points by their angle around the origin."""
    p = points(spark, d).withColumn("a", F.atan2("y", "x")).where("x <> 0 or y <> 0")
    return scans.numbered(p, ["a", "row_id"], ["grp"], "seq").select("grp", F.lit(0).alias("part"), "seq", "x", "y")


_RING_AREA = ", r as (select grp, x, y, row_number() over (partition by grp order by atan2(y, x), row_id) s from points where x <> 0 or y <> 0), n as (select *, coalesce(lead(x) over w, first_value(x) over w) nx, coalesce(lead(y) over w, first_value(y) over w) ny from r window w as (partition by grp order by s))"


@query(_RING_AREA + " select grp, round(abs(sum(x * ny - nx * y)) / 2, 6) area from n group by 1", "points")
def tessellate(spark, d):
    t = shapes.tessellate(_rings(spark, d), "grp", "part", "seq")
    corners = t.groupBy("grp", "triangle").agg(F.array_sort(F.collect_list(F.struct("corner", "x", "y"))).alias("p"))
    x, y = lambda k: F.col("p")[k]["x"], lambda k: F.col("p")[k]["y"]
    twice = (x(1) - x(0)) * (y(2) - y(0)) - (x(2) - x(0)) * (y(1) - y(0))
    return corners.groupBy("grp").agg(_r(F.sum(F.abs(twice)) / 2).alias("area"))


def _area(df, *keys):
    """The area of rings and holes: half the sum of their signed cross products, closed."""
    w = Window.partitionBy(*keys, "part").orderBy("seq")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(every)) for c in ("x", "y"))
    return df.withColumn("c", F.col("x") * ny - nx * F.col("y")).groupBy(*keys).agg(F.abs(F.sum("c") / 2).alias("area"))


_BOX = [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]


#: Areas and edges of the four operations on every pair of rings of ra (a, s, x, y) and rb (b, s, x, y), edge by edge.
_OVERLAY = """, ca as (select a, s, x px, y py, coalesce(lead(x) over w, first_value(x) over w) qx, coalesce(lead(y) over w, first_value(y) over w) qy from ra window w as (partition by a order by s)
), cb as (select b, s, x px, y py, coalesce(lead(x) over w, first_value(x) over w) qx, coalesce(lead(y) over w, first_value(y) over w) qy from rb window w as (partition by b order by s)
), met as (
  select a, b, ca.s i, cb.s j, ca.px, ca.py, ca.qx - ca.px dx, ca.qy - ca.py dy,
    ((cb.px - ca.px) * (cb.qy - cb.py) - (cb.py - ca.py) * (cb.qx - cb.px)) / ((ca.qx - ca.px) * (cb.qy - cb.py) - (ca.qy - ca.py) * (cb.qx - cb.px)) t,
    ((cb.px - ca.px) * (ca.qy - ca.py) - (cb.py - ca.py) * (ca.qx - ca.px)) / ((ca.qx - ca.px) * (cb.qy - cb.py) - (ca.qy - ca.py) * (cb.qx - cb.px)) u
  from ca, cb where (ca.qx - ca.px) * (cb.qy - cb.py) - (ca.qy - ca.py) * (cb.qx - cb.px) <> 0
), cut as (select a, b, i, j, t, u, px + t * dx x, py + t * dy y from met where t > 0 and t < 1 and u > 0 and u < 1
), spots as (
  select a, b, 0 own, s e, 0.0::double t, px x, py y from ca, (select distinct b from rb) union all select a, b, 0, s, 1.0::double, qx, qy from ca, (select distinct b from rb)
  union all select a, b, 0, i, t, x, y from cut union all select a, b, 1, j, u, x, y from cut
  union all select a, b, 1, s, 0.0::double, px, py from cb, (select distinct a from ra) union all select a, b, 1, s, 1.0::double, qx, qy from cb, (select distinct a from ra)
), piece as (
  select row_number() over () k, * from (select a, b, own, x px, y py, lead(x) over w qx, lead(y) over w qy from spots window w as (partition by a, b, own, e order by t)) where qx is not null
), ray as (
  select k, count(*) % 2 = 1 odd from piece p join (select a id, 1 other, px ax, py ay, qx bx, qy "by" from ca union all select b, 0, px, py, qx, qy from cb) o
    on o.other = p.own and o.id = case when p.own = 0 then p.b else p.a end
  where (ay > (py + qy) / 2) <> ("by" > (py + qy) / 2) and (px + qx) / 2 < (bx - ax) * ((py + qy) / 2 - ay) / ("by" - ay) + ax group by 1
), judged as (select p.*, coalesce(odd, false) inside, (px * qy - qx * py) / 2 c from piece p left join ray using (k)
), found as (
  select a, b, 'intersection' operation, sum(c) area, count(*) edges from judged where inside group by 1, 2
  union all select a, b, 'union', sum(c), count(*) from judged where not inside group by 1, 2
  union all select a, b, 'difference', sum(case when own = 0 then c else -c end), count(*) from judged where own = 0 and not inside or own = 1 and inside group by 1, 2
  union all select a, b, 'exclusive-or', sum(case when inside then -2 * c else c end) + sum(case when inside then c else 0 end), count(*) from judged group by 1, 2
)"""
_STARS = ", ra as (select grp a, x, y, row_number() over (partition by grp order by atan2(y, x), row_id) s from points where x <> 0 or y <> 0)"


def _combined(found, a, b):
    """(a, b, operation, area, edges) of the rings of an overlay."""
    return _area(found.withColumn("__e", F.lit(1)), "operation", a, b).join(found.groupBy("operation", a, b).agg(F.count("*").alias("edges")), ["operation", a, b]).withColumn("area", _r("area", 5))


@query(_STARS + ", rb as (select 0 b, unnest([1, 2, 3, 4]) s, unnest([-0.1, 0.1, 0.1, -0.1])::double x, unnest([-0.1, -0.1, 0.1, 0.1])::double y)" + _OVERLAY + " select a grp, operation, round(area, 5) area, edges from found", "points")
def clip_shapes(spark, d):
    """Each group's ring combined with one box in all four ways: the areas and edges of each."""
    found = _combined(shapes.clip(_rings(spark, d), "grp", "seq", _BOX), "grp", "__clip")
    return found.select("grp", "operation", "area", "edges")


@query(
    _STARS + """, other as (select vec_id, label, round(cast(embedding[3] as double), 6) x, round(cast(embedding[4] as double), 6) y from embeddings
), rb as (select label b, x, y, row_number() over (partition by label order by atan2(y, x), vec_id) s from other where x <> 0 or y <> 0)"""
    + _OVERLAY + " select a, b, operation, round(area, 5) area, edges from found", "points",
)
def overlay_layers(spark, d):
    """Two layers of rings, every pair of them combined in all four ways."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("b"), *[F.round(F.col("embedding")[k].cast("double"), 6).alias(n) for k, n in ((2, "x"), (3, "y"))])
    right = e.where("x <> 0 or y <> 0").withColumn("seq", F.row_number().over(Window.partitionBy("b").orderBy(F.atan2("y", "x"), "vec_id")))
    return _combined(overlay.overlay(_rings(spark, d).withColumnRenamed("grp", "a"), right, "a", "b", "seq", 0.05), "a", "b").select("a", "b", "operation", "area", "edges")


@query(
    _RING_AREA + """ select grp, count(*) over (partition by grp) edges, px, py, qx, qy from (
  select grp, round(x, 6) px, round(y, 6) py, round(nx, 6) qx, round(ny, 6) qy from n) where px <> qx or py <> qy""", "points",
)
def dissolve_shapes(spark, d):
    """The triangles of a ring, put together again: its edges, in order, and no other."""
    t = shapes.tessellate(_rings(spark, d), "grp", "part", "seq")
    found = stored(outlines.dissolve(t, ["grp"], "triangle", "corner"))
    # vertices meet the next ones by their numbers, so no task has a ring; the first follows the last
    v = found.select("grp", "part", "seq", F.col("x").alias("qx"), F.col("y").alias("qy"))
    last = found.groupBy("grp", "part").agg(F.max("seq").alias("last"))
    closing = v.where("seq = 0").alias("t").join(last.alias("u"), outlines.same("t", "u", ["grp", "part"])).select("t.grp", "t.part", F.col("last").alias("seq"), "qx", "qy")
    ahead = v.where("seq > 0").withColumn("seq", F.col("seq") - 1).union(closing)
    edges = found.alias("t").join(ahead.alias("u"), outlines.same("t", "u", ["grp", "part", "seq"])).select("t.grp", F.col("x").alias("px"), F.col("y").alias("py"), "qx", "qy")
    counted = F.broadcast(found.groupBy("grp").agg(F.count("*").alias("edges")))
    return edges.alias("t").join(counted.alias("u"), outlines.same("t", "u", ["grp"])).select("t.grp", "edges", "px", "py", "qx", "qy")


@query("select grp, count(*) cells, 4.0::double area from (select distinct grp, x, y from points) group by 1", "points")
def voronoi_cells(spark, d):
    """The cells of a group's points part the box: as many as points, with its area in all."""
    cells = voronoi.voronoi(points(spark, d), "grp", "row_id", (-1.0, -1.0, 1.0, 1.0)).withColumn("part", F.lit(0))
    return _area(cells, "grp", "row_id").groupBy("grp").agg(F.count("*").alias("cells"), _r(F.sum("area"), 5).alias("area"))


@query(
    """, q as (select vec_id probe, label grp, round(cast(embedding[3] as double), 6) x, round(cast(embedding[4] as double), 6) y from embeddings)
select probe, arg_min(row_id, struct_pack(d := (q.x - p.x) ** 2 + (q.y - p.y) ** 2, k := row_id)) site from q join points p using (grp) group by 1""".replace(", q as", ", q as", 1),
    "points",
)
def voronoi_sites(spark, d):
    """The site in whose cell each other point lies is the site nearest to it."""
    cells = voronoi.voronoi(points(spark, d), "grp", "row_id", (-1.0, -1.0, 1.0, 1.0))
    probes = table(spark, d, "embeddings").select(F.col("vec_id").alias("probe"), F.col("label").alias("grp"), *[F.round(F.col("embedding")[k].cast("double"), 6).alias(n) for k, n in ((2, "px"), (3, "py"))])
    held = voronoi.holders(cells, probes, "grp", "row_id", "probe")
    return held.groupBy("probe").agg(F.min("row_id").alias("site"))


@query(
    """with v as (select vec_id, unnest(range(len(embedding))) k, cast(unnest(embedding) as double) v, len(embedding) n from embeddings),
  w as (select vec_id, k - s * 16 i, v, s from v, (select unnest(range(1000)) s) where k >= s * 16 and k < s * 16 + 32 and s <= (greatest(0, n - 32)) // 16),
  f as (select vec_id, s, h, pow(sum(v * cos(2 * pi() * h * i / 32)), 2) + pow(sum(v * sin(2 * pi() * h * i / 32)), 2) p from w, (select unnest(range(17)) h) group by 1, 2, 3)
  select vec_id, cast(s as int) as window, round(sum(p) filter (h < 4) / sum(p) filter (h >= 4), 4) ratio from f group by 1, 2"""
)
def fft_ratio(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return spectra.low_share(e, "vec_id", "k", "v", 32, 4).withColumn("ratio", _r("ratio", 4))


@query(
    """select row_id, round(x, 6) x, round(y, 6) y from points where grp % 2 = 1
union all select row_id, round(x + dx, 6), round(y + dy, 6) from points, (
  select case when bx - ax <= by_ - ay then bx - cx else 0 end dx, case when bx - ax <= by_ - ay then 0 else by_ - cy end dy
  from (select min(x) ax, max(x) bx, min(y) ay, max(y) by_ from points where grp % 2 = 1), (select min(x) cx, min(y) cy from points where grp % 2 = 0)) where grp % 2 = 0""",
    "points",
)
def tile_beside(spark, d):
    """The odd groups as one layer, and the even ones beside it."""
    p = points(spark, d)
    found = shapes.place_beside(p.where("grp % 2 = 1").select("row_id", "x", "y"), p.where("grp % 2 = 0").select("row_id", "x", "y"))
    return found.select("row_id", _r("x").alias("x"), _r("y").alias("y"))


@query("select i::int i, j::int j, round(-1 + i * 0.25, 6) x0, round(-1 + j * 0.25, 6) y0 from (select unnest(range(8)) i), (select unnest(range(8)) j)")
def tile_grid(spark, d):
    return generate.tiles(spark, -1, -1, 1, 1, 0.25).select("i", "j", _r("x0").alias("x0"), _r("y0").alias("y0"))


@query("select id seq, round(cos(id * 2 * pi() / 50), 6) x, round(sin(id * 2 * pi() / 50), 6) y from (select unnest(range(50)) id)")
def generate_circle(spark, d):
    return generate.circle(spark).select("seq", _r("x").alias("x"), _r("y").alias("y"))


# Changes and serving


_CHANGES = [
    {"id": 2, "filename": "customer", "search_fields": '{"c_mktsegment": "RENAMED"}', "update_fields": {"note": "twice", "c_nationkey": 99}},
    {"id": 1, "filename": "customer", "search_fields": {"c_mktsegment": "BUILDING"}, "update_fields": '{"c_mktsegment": "RENAMED"}'},
    {"id": 3, "filename": "supplier", "search_fields": {"c_custkey": 1}, "update_fields": {"note": "not this table"}},
]


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'RENAMED' else c_mktsegment end c_mktsegment, case when c_mktsegment = 'BUILDING' then 99 else c_nationkey end c_nationkey, case when c_mktsegment = 'BUILDING' then 'twice' else '' end note from customer")
def run_changes(spark, d):
    return changes.replay(table(spark, d, "customer"), _CHANGES, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "note")


@query("select row_id, x, y from points where x between 0.02 - 0.006 and 0.02 + 0.006 and y between -0.01 - 0.006 and -0.01 + 0.006", "points")
def near_service(spark, d):
    return serving.near(points(spark, d), -0.01, 0.02, 9.0).select("row_id", "x", "y")


def _side_sql(name, rank, turn):
    total, meter = f"num_{name}_tickets", f"num_{name}_meter_tickets"
    risk = lambda h, n: f"case when {meter} > 0 then least(1.0, {meter}_within_{h}h * {n}.0::double) else 0.0::double end"
    return f"""select id, '{name.upper()}' side, {rank} as rank, {total} total, {meter} total_meter, {risk(1, 336)} risk_1h, {risk(3, 112)} risk_3h, greatest(0.5::double, {risk(6, 56)}) risk_6h,
  id / 10000.0::double + cos(0.5{turn}) * 0.0002 / 2 mx, numeric_address / 10000.0::double + sin(0.5{turn}) * 0.0002 / 2 my, cos(0.5 + pi() / 2) * 0.0001 * 0.8 rx, sin(0.5 + pi() / 2) * 0.0001 * 0.8 ry from totals"""


@query(f"with totals as ({SQL['ticket_totals']}), sides as ({_side_sql('op', 0, ' + pi()')} union all {_side_sql('at', 1, '')}) select id, side, rank, total, total_meter, risk_1h, risk_3h, risk_6h, round(mx + rx, 6) x1, round(my + ry, 6) y1, round(mx - rx, 6) x2, round(my - ry, 6) y2 from sides where total > 5 or total_meter > 5")
def near_sides(spark, d):
    t = ticket_totals(spark, d).withColumns({"x": F.col("id") / 1e4, "y": F.col("numeric_address") / 1e4, "angle": F.lit(0.5), "road_width": F.lit(0.0002), "radius": F.lit(0.0001)})
    return serving.side_rows(t, least=5).withColumns({c: _r(c) for c in ("x1", "y1", "x2", "y2")})


@query(
    _SLOTS
    + """, a as (select p.*, substr(p.half_hourly || coalesce(q.half_hourly, repeat(' ', 48)), 21, 6) ahead from p left join p q on q.geo_id = p.geo_id and q.is_opp = p.is_opp and q.infraction_code = p.infraction_code and q.wday = (p.wday + 1) % 7),
  n as (select geo_id, tickets_all_day, list_transform(range(1, 7), lambda i: ascii(substr(ahead, i, 1)) - 32) c from a where wday = 2 and is_opp = 1 and infraction_code in (5, 9, 29))
  select geo_id, """
    + ", ".join(f"round(least(1.0, sum(list_sum(c[1:{2 * k}])) * {48 / (2 * k)}::double / sum(tickets_all_day)), 6) risk_{k}h" for k in (1, 2, 3))
    + " from n group by 1",
    "tickets",
)
def line_risk(spark, d):
    h = _hist(spark, d).withColumn("half_hourly", A.as_printable(F.col("slots"))).drop("slots")
    both = A.with_tomorrow(h, ["geo_id", "is_opp", "infraction_code"]).where("wday = 2 and is_opp = 1")
    return serving.line_risk(both, serving.round_up(600), [5, 9, 29])


@query("select c_custkey k, c_name as name from customer where c_custkey not in (select s_suppkey * 3 from supplier) union all select s_suppkey * 3, s_name from supplier")
def upsert(spark, d):
    """Every third customer's row replaced by a supplier's, and those beyond the customers added."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return serving.upsert(c, table(spark, d, "supplier").select((3 * F.col("s_suppkey")).alias("k"), F.col("s_name").alias("name")), ["k"])


@query("select id, cast(street_id as int) geo_id, side arc_side, numeric_address + case when street_id = 3 and side = 1 then 100 else 0 end x from addresses where street_id <> 4 or side <> 0", "addresses")
def reload_line(spark, d):
    """Lines in a partition each; two are worked out anew, of which one is empty now. The others keep their files."""
    a = addresses(spark, d).select("id", F.col("numeric_address").alias("x"), F.col("street_id").cast("int").alias("geo_id"), F.col("side").alias("arc_side"))
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    a.repartition("geo_id", "arc_side").write.partitionBy("geo_id", "arc_side").parquet(path)
    edited = a.where("geo_id <> 4 or arc_side <> 0").withColumn("x", F.col("x") + 100)
    serving.refresh_key(edited, path, ["geo_id", "arc_side"], 3, 1)
    return serving.refresh_key(edited, path, ["geo_id", "arc_side"], 4, 0)


@query("select row_id, grp shape_row_id, 0 shape_part_id, 5 shape_part_type, x lon, y + 1 lat, x + y total, 0.0::double deep, 0.0::double red, 0.0::double blue, 1.0::double alpha from points", "points")
def shape_columns(spark, d):
    """Ids, colours and coordinates under their other names."""
    p = points(spark, d).withColumnsRenamed({"x": "lon", "y": "lat", "grp": "shape_row_id"})
    p = G.add_rgb(G.add_shape_columns(p), alpha=True)
    p = p.withColumns({"total": G.coordinate(p, "x") + G.coordinate(p, "y"), "deep": G.coordinate(p, "z"), "green": F.lit(0.5)})
    p = G.set_columns(p, y=G.coordinate(p, "y") + 1, shape_part_type=5)
    return G.blank(p, "green").where("green = 0").drop("green")


# Streams, run over what is there


def _event_stream(spark, d):
    batch = table(spark, d, "events")
    return spark.readStream.schema(batch.schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2")
def stream_tumbling(spark, d):
    found = stream.drained(spark, stream.tumbling(_event_stream(spark, d), "ts", "1 day", ["event_type"], "value"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select user_id, max(ts) as ts from events group by 1")
def stream_latest(spark, d):
    found = stream.drained(spark, stream.latest(_event_stream(spark, d), "user_id", "ts", "event_id"))
    return found.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("select event_id, user_id from events")
def stream_retention(spark, d):
    return stream.drained(spark, stream.retain(_event_stream(spark, d), "ts", ["event_id"]), "append").select("event_id", "user_id")


@query("select cast(user_id as varchar) user_id, event_id, epoch_us(ts) // 1000 + 86400000 expired from events where epoch_us(ts) // 1000 + 86400000 <= (select max(epoch_us(ts) // 1000) from events)")
def stream_expired(spark, d):
    """Events that a day's retention has let go by the end of the stream, by timers of their key's state."""
    found = stream.drained(spark, stream.expiring(_event_stream(spark, d), "user_id", "event_id", "ts", 24 * 3600 * 1000), "append", stream.ROCKS)
    return found.select(F.col("key").alias("user_id"), F.col("event").alias("event_id"), "expired")


@query("select event_id from events where ts >= (select max(ts) from events) - interval 6 hours")
def recent_events(spark, d):
    return stream.recent(table(spark, d, "events"), "ts", "6 hours").select("event_id")


@query(
    """, f as (select *, case when y < lag(y) over w then 1 else 0 end fell from tracks window w as (partition by shape_row_id order by x, y)),
  t as (select *, sum(fell) over (partition by shape_row_id order by x, y) trip from f),
  m as (select shape_row_id, trip, count(*) n, max(trip) over (partition by shape_row_id) lasting from t group by 1, 2)
  select cast(shape_row_id as varchar) vehicle, cast(trip as bigint) trip, n from m where trip < lasting""",
    "tracks",
)
def stream_trips(spark, d):
    return stream.drained(spark, stream.trips(_event_stream(spark, d), "user_id", "ts", "value"), "append").select("vehicle", "trip", "n")


# Sources and sinks: tables written by the engine's writers to the shared folder, and read back by its readers


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}"


@query("select c_custkey, c_name, round(c_acctbal, 2) c_acctbal, c_mktsegment || ', \"' || c_nationkey || '\"' note from customer")
def csv_round_trip(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.concat("c_mktsegment", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"')).alias("note"))
    path = f"{_folder(spark)}.csv"
    writers.write_csv(c, path, order=["c_custkey"])
    back = delimited.read_delimited(spark, path)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", _r(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"), "note")


@query("select c_custkey, c_name, c_nationkey from customer")
def json_round_trip(spark, d):
    path = _folder(spark)
    writers.write_json(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return spark.read.schema("c_custkey long, c_name string, c_nationkey int").json(path).select("c_custkey", "c_name", "c_nationkey")


@query("select grp, row_id, x, y from points", "points")
def shapefile_round_trip(spark, d):
    p = points(spark, d)
    path = f"{_folder(spark)}.shp"
    rows = p.select(F.col("grp").alias("shape_row_id"), F.lit(0).alias("shape_part_id"), F.col("row_id").alias("seq"), "x", "y", "grp")
    shapefile.write_shapefile(rows, path, ["grp"], kind=shapefile.ARC)
    back = shapefile.read_shapefile(spark, path)
    w = Window.partitionBy("grp").orderBy("seq")
    own = p.select(F.col("grp").alias("g"), "row_id", F.row_number().over(Window.partitionBy("grp").orderBy("row_id")).alias("k"))
    met = back.withColumn("n", F.row_number().over(w)).join(own, (F.col("grp") == F.col("g")) & (F.col("n") == F.col("k")))
    return met.select(F.col("g").alias("grp"), "row_id", _r("x").alias("x"), _r("y").alias("y"))


@query("select cast(grp as varchar) name, count(*) n, round(sum(x), 3) sx, round(sum(y), 3) sy from points group by 1", "points")
def kml_round_trip(spark, d):
    path = f"{_folder(spark)}.kml"
    rows = points(spark, d).select(F.col("grp").alias("shape_row_id"), F.lit(0).alias("shape_part_id"), F.col("row_id").alias("seq"), "x", "y", F.col("grp").cast("string").alias("name"))
    writers.write_kml(rows, path, "name")
    return files.read_kml(spark, path).groupBy("name").agg(F.count("*").alias("n"), _r(F.sum("x"), 3).alias("sx"), _r(F.sum("y"), 3).alias("sy"))


@query("select c_custkey, c_name from customer")
def sql_round_trip(spark, d):
    """The rows of the INSERT statements, taken apart again."""
    path = f"{_folder(spark)}.sql"
    writers.write_sql(table(spark, d, "customer").select("c_custkey", "c_name"), path, "customers", drop=True)
    rows = F.explode(F.regexp_extract_all("value", F.lit(r'\((\d+,"[^"]*")\)'), F.lit(1)))
    parts = spark.read.text(path).where("value like 'INSERT INTO `customers`%'").select(rows.alias("r")).select(F.split("r", ",").alias("p"))
    return parts.select(F.col("p")[0].cast("long").alias("c_custkey"), F.regexp_replace(F.col("p")[1], '"', "").alias("c_name"))


@query("select c_custkey, c_name from customer")
def js_round_trip(spark, d):
    """What stands after the assignment is JSON."""
    path = f"{_folder(spark)}.js"
    writers.write_js(table(spark, d, "customer").select("c_custkey", "c_name"), path, "customers")
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.regexp_replace("value", r"^var customers = ", ""), r";\s*$", "").alias("v"))
    found = text.select(F.from_json("v", "blocks array<struct<rows array<array<string>>>>").alias("j")).select(F.explode(F.col("j.blocks")[0]["rows"]).alias("r"))
    return found.select(F.col("r")[0].cast("long").alias("c_custkey"), F.col("r")[1].alias("c_name"))


@query("select o_orderkey, o_custkey, o_orderstatus || chr(10) || '\"' || o_custkey || '\",' || chr(10) || chr(10) || o_orderkey note from orders")
def csv_quoted_breaks(spark, d):
    """Quoted line breaks, quotes and commas in one file that several tasks read."""
    path = f"{_folder(spark)}.csv"
    note = F.concat("o_orderstatus", F.lit('\n"'), F.col("o_custkey").cast("string"), F.lit('",\n\n'), F.col("o_orderkey").cast("string"))
    writers.write_csv(table(spark, d, "orders").select("o_orderkey", "o_custkey", note.alias("note")), path)
    back = delimited.read_delimited(spark, path, 1 << 14)
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "note")


def _street_map(spark, d):
    """A file of parts as nodes and orders as ways along their parts, in blobs of 500 items, read by ranges of blobs."""
    path = f"{_folder(spark)}.pbf"
    p, line = table(spark, d, "part"), table(spark, d, "lineitem")
    place = [F.lit("node").alias("kind"), F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") + F.col("p_partkey") % 1000 / 1000).alias("lat"), (F.col("p_partkey") % 360 - 179.5).alias("lon")]
    nodes = p.select(*place, F.lit(None).cast("array<long>").alias("refs"))
    refs = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("long").alias("p")))), lambda v: v["p"])
    ways = line.groupBy(F.col("l_orderkey").cast("long").alias("id")).agg(refs.alias("refs")).select(F.lit("way").alias("kind"), "id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "refs")

    def blobs(frames):
        for frame in frames:
            for low in range(0, len(frame), 500):
                yield pd.DataFrame({"blob": [files.osm_blob(frame[low : low + 500].itertuples(index=False))]})

    single.write_bytes(nodes.union(ways).mapInPandas(blobs, "blob binary"), path)
    return files.read_osm(spark, path, 1 << 14)


@query("""select cast(p_partkey as bigint) id, round(p_size + p_partkey % 1000 / 1000, 6) lat, p_partkey % 360 - 179.5::double lon, coalesce(n, 0) num_ways
  from part left join (select l_partkey, count(distinct l_orderkey) n from lineitem group by 1) on p_partkey = l_partkey""")
def osm_nodes(spark, d):
    """Nodes with the number of ways through them."""
    return files.osm_nodes(_street_map(spark, d)).select("id", _r("lat").alias("lat"), _r("lon").alias("lon"), "num_ways")


@query("select cast(l_orderkey as bigint) id, string_agg(l_partkey, ',' order by l_linenumber, l_partkey) refs from lineitem group by 1")
def osm_ways(spark, d):
    """Ways with their nodes in order."""
    return _street_map(spark, d).where("kind = 'way'").select("id", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))


@query("select l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, l_extendedprice from lineitem where l_quantity > 20")
def block_round_trip(spark, d):
    """Written in a file a partition, read back in ranges of rows by several tasks each."""
    path = _folder(spark).removeprefix("file:")
    spark.dataSource.register(blockfile.BlockDataSource)
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
    t.write.format("block").option("width", "3").mode("append").save(path)
    found = blockfile.read_blocks(spark, path, 1 << 16)
    return found.select(*t.columns).where("l_quantity > 20")


@query("select cast(l_orderkey as int) okey, first(l_returnflag) over w flag, cast(row_number() over w - 1 as int) vertex, cast(l_partkey as double) x, cast(l_suppkey as double) y from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag)")
def shapefile_polygons(spark, d):
    """Orders as polygons along their lines, the file read in ranges of records."""
    path = f"{_folder(spark)}.shp"
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")) - 1
    own = table(spark, d, "lineitem").withColumn("seq", at)
    flag = F.first("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy("seq"))
    rows = own.select(F.col("l_orderkey").alias("shape_row_id"), F.lit(0).alias("shape_part_id"), "seq", F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"), F.col("l_orderkey").cast("int").alias("okey"), flag.alias("flag"))
    shapefile.write_shapefile(rows, path, ["okey", "flag"])
    back = shapefile.read_shapefile(spark, path, most=1 << 16)
    first = F.min("seq").over(Window.partitionBy("shape_row_id"))
    return back.select("okey", "flag", (F.col("seq") - first).cast("int").alias("vertex"), "x", "y")


@query("select cast(c_custkey as int) id, c_name as name, cast(c_acctbal as double) x, cast(c_nationkey as double) y, 1 kind from customer")
def shapefile_points(spark, d):
    path = f"{_folder(spark)}.shp"
    place = [F.col("c_custkey").alias("shape_row_id"), F.lit(0).alias("shape_part_id"), F.lit(0).alias("seq"), F.col("c_acctbal").cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y")]
    shapefile.write_shapefile(table(spark, d, "customer").select(*place, F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("name")), path, ["id", "name"], kind=shapefile.POINT)
    return shapefile.read_shapefile(spark, path, most=1 << 14).select("id", "name", "x", "y", F.col("shape_part_type").alias("kind"))


@query("select s_name stop, count(l_orderkey) visits, count(distinct l_orderkey) trips from supplier left join lineitem on l_suppkey = s_suppkey group by 1")
def transit_feed(spark, d):
    """Suppliers as stops that orders call at, as a transit feed's tables."""
    folder = _folder(spark)
    writers.write_csv(table(spark, d, "supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name")), f"{folder}/stops.txt")
    writers.write_csv(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence")), f"{folder}/stop_times.txt")
    feed = feeds.read_transit(spark, folder, "stops", "stop_times")
    met = feed["stops"].join(feed["stop_times"], "stop_id", "left")
    return met.groupBy(F.col("stop_name").alias("stop")).agg(F.count("trip_id").alias("visits"), F.count_distinct("trip_id").alias("trips"))


_SAMPLE = "(event_id * 7919 + cast(floor(abs(coalesce(value, 0)) * 100) as bigint)) % 20001 - 10000"


@query(f"select cast(i // w as int) as window, round(sqrt(avg(v * v)), 4) rms from (select row_number() over (order by event_id) - 1 i, cast({_SAMPLE} as double) v, cast(ceil(count(*) over () / 100) as bigint) w from events) group by 1")
def sound_windows(spark, d):
    """Events as the samples of a sound, whose loudness is told in windows."""
    path = f"{_folder(spark)}.wav"
    events = table(spark, d, "events").repartitionByRange("event_id").sortWithinPartitions("event_id").select(F.expr(f"cast({_SAMPLE} as smallint)").alias("v"))
    size = 2 * events.count()
    head = b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", size)
    samples = events.mapInPandas(lambda frames: (pd.DataFrame({"piece": [f["v"].to_numpy("<i2").tobytes()]}) for f in frames), "piece binary")
    single.write_bytes(spark.createDataFrame([(bytearray(head),)], "piece binary").coalesce(1).union(samples), path)
    return files.read_wave(spark, path).select("window", _r("rms", 4).alias("rms"))


@query(
    """, b as (select min(x) ax, max(x) - min(x) wide, min(y) ay, max(y) - min(y) tall from points),
  s as (select *, cast(greatest(1, floor(least(1000 * tall / wide, 1500))) as bigint) h from b),
  p as (select grp, round((0.01::double + 0.98::double * (x - ax) / wide) * 999) px, round((h - 1) - (0.01::double + 0.98::double * (y - ay) / tall) * (h - 1)) py from points, s)
  select cast(px as int) px, cast(py as int) py, round(max(grp) / 100, 2) red from p group by 1, 2""",
    "points",
)
def png_pixels(spark, d):
    """The pixels of a picture of points; the last shape wins."""
    p = points(spark, d).select(F.col("grp").alias("shape_row_id"), F.lit(0).alias("shape_part_id"), F.col("row_id").alias("seq"), F.lit(0).alias("shape_part_type"), "x", "y", (F.col("grp") / 100).alias("red"))
    found, _, _ = writers.pixels(p)
    return found.select("px", "py", _r("red", 2).alias("red"))


SQL["png_pixels"] = SQL["png_pixels"].replace(") , b as", "), b as")


@query(
    """select c_nationkey, min(o_orderkey) first_order, arg_min(c_mktsegment || ' ' || o_orderstatus, o_orderkey) label, arg_min(o_custkey, o_orderkey) o_custkey
  from orders join customer on o_custkey = c_custkey group by 1"""
)
def command_line(spark, d):
    """A pipeline as text: a join, a text of two columns, the first order of each nation."""
    text = f"read {d}/orders.parquet | join --file={d}/customer.parquet --left=o_custkey --right=c_custkey --join=inner | strcat --columns=c_mktsegment,o_orderstatus --name=label | unique --column=c_nationkey --order=o_orderkey"
    return cli.run(spark, text).select("c_nationkey", F.col("o_orderkey").alias("first_order"), "label", "o_custkey")


# Aggregates and joins that Spark gives as they are


@query("select coalesce(n_regionkey, -1) n_regionkey, coalesce(n_nationkey, -1) n_nationkey, count(*) n, grouping(nation.n_regionkey) as region_of_all from supplier join nation on s_nationkey = n_nationkey group by rollup (nation.n_regionkey, nation.n_nationkey)")
def rollup_counts(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return _shown(s.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"), F.grouping("n_regionkey").cast("long").alias("region_of_all")), "n_regionkey", "n_nationkey")


@query("select coalesce(n_regionkey, -1) n_regionkey, coalesce(s_nationkey, -1) s_nationkey, count(distinct s_suppkey) n from supplier join nation on s_nationkey = n_nationkey group by cube (nation.n_regionkey, supplier.s_nationkey)")
def cube_distinct(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return _shown(s.cube("n_regionkey", "s_nationkey").agg(F.count_distinct("s_suppkey").alias("n")), "n_regionkey", "s_nationkey")


@query("select coalesce(c_nationkey, s_nationkey) nation, coalesce(c, -1) c, coalesce(s, -1) s from (select c_nationkey, count(*) c from customer group by 1) full join (select s_nationkey, count(*) s from supplier where s_acctbal > 0 group by 1) on c_nationkey = s_nationkey")
def full_outer(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    s = table(spark, d, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), F.coalesce("c", F.lit(-1)).alias("c"), F.coalesce("s", F.lit(-1)).alias("s"))


@query("select a.event_id, b.event_id next_id from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 1 hour")
def interval_join(spark, d):
    """Events of one user within the hour after another: an equi join with a range on what meets."""
    e = table(spark, d, "events")
    b = e.select(F.col("event_id").alias("next_id"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    met = e.join(b, F.col("user_id") == F.col("u")).where((F.col("t") > F.col("ts")) & (F.col("t") <= F.col("ts") + F.expr("interval 1 hour")))
    return met.select("event_id", "next_id")


# Columns, colours and vectors, continued


@query("select o_orderkey, cast(o_totalprice as double) price from orders")
def columns_makefloat(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit(" "), F.col("o_totalprice").cast("double").cast("string"), F.lit(" CAD")).alias("price"))
    return columns.edit_columns(t, to_double=["price"])


@query("select p_partkey, p_size * 2.5::double size, p_size - 7.25::double less from part")
def multiply_offset(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_size").cast("double").alias("less"))
    return columns.offset(columns.multiply(t, "size", 2.5), "less", -7.25)


@query("select row_id, coalesce(round((x - min(x) over w) / nullif(max(x) over w - min(x) over w, 0), 6), -1) x, coalesce(round((y - min(y) over w) / nullif(max(y) over w - min(y) over w, 0), 6), -1) y from points window w as (partition by grp)", "points")
def normalize_shapes(spark, d):
    n = columns.normalize(points(spark, d), ["x", "y"], within=["grp"])
    return n.select("row_id", *[F.coalesce(_r(c), F.lit(-1.0)).alias(c) for c in ("x", "y")])


@query("select row_id, case grp % 4 when 1 then 0.2::double when 2 then 0.9 else grp % 4 / 10.0::double end red, case grp % 4 when 1 then 0.4::double when 2 then 0.8 else 0.5 end green, case grp % 4 when 1 then 0.6::double when 2 then 0.7 else 0.5 end blue from points", "points")
def translate_colors(spark, d):
    t = points(spark, d).select("row_id", (F.col("grp") % 4 / 10.0).alias("red"), F.lit(0.5).alias("green"), F.lit(0.5).alias("blue"))
    return columns.replace_colours(t, [((0.1, 0.5, 0.5), (0.2, 0.4, 0.6)), ((0.2, 0.5, 0.5), (0.9, 0.8, 0.7)), ((0.1, 0.5, 0.5), (1.0, 1.0, 1.0))])


@query("select grp, count(*) n, 1::bigint colours, 0::bigint outside, 1.0::double alpha from points group by 1", "points")
def random_colors(spark, d):
    """Each shape has one colour, with parts from 0 to 1, and is opaque."""
    t = columns.random_colours(points(spark, d), 7, ["grp"])
    outside = F.count_if((F.least("red", "green", "blue") < 0) | (F.greatest("red", "green", "blue") > 1))
    return t.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("red", "green", "blue").alias("colours"), outside.alias("outside"), F.min("alpha").alias("alpha"))


@query("select row_id, case grp when 1 then 1.0::double when 3 then 0.25::double else 0.0::double end red, case grp when 3 then 0.5::double else 1.0::double end alpha from points", "points")
def color_by_id(spark, d):
    """Rules by a shape's number; the last one counts."""
    rules = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0, 1.0), (2, 3, 1.0, 0.0, 0.0, 1.0), (3, 3, 0.25, 0.5, 0.75, 0.5)], "rule int, grp int, red double, green double, blue double, alpha double")
    return columns.colour_by_rules(points(spark, d), rules, "grp").select("row_id", "red", "alpha")


@query(
    """select row_id, round(x * (pi() / 7) - y * 2.0, 6) dot, round(x * (-2.0) - y * (pi() / 7), 6) across, round(sqrt(x * x + y * y), 6) len, round(coalesce(x / nullif(sqrt(x * x + y * y), 0), 0), 6) unit_x,
  round(cos(0.5) * x - sin(0.5) * y, 6) turned_x, round(y * y - 1.0 * x, 6) cross_x, round(x * x - y * y, 6) cross_z, round(x + 3.0 * (y - 0.5), 6) moved from points""",
    "points",
)
def vector_ops(spark, d):
    x, y, one = F.col("x"), F.col("y"), F.lit(1.0)
    v, w = (x, y), (F.pi() / 7, F.lit(-2.0))
    c = vectors.cross((x, y, one), (y, x, y))
    moved = vectors.add((x,), vectors.scale(vectors.subtract((y,), (F.lit(0.5),)), 3.0))[0]
    found = {"dot": vectors.dot(v, w), "across": vectors.cross(v, w)[0], "len": vectors.length(v), "unit_x": F.coalesce(vectors.unit(v)[0], F.lit(0.0)), "turned_x": vectors.turned(v, 0.5)[0], "cross_x": c[0], "cross_z": c[2], "moved": moved}
    return points(spark, d).select("row_id", *[_r(f).alias(n) for n, f in found.items()])


# Rows, lookups and neighbours, continued


SQL["thin_euclid"] = (
    sql("", "tracks").rstrip().replace("with tracks", "with recursive tracks", 1)
    + ", numbered as (select shape_row_id, event_id, x, y / 20 y, row_number() over (partition by shape_row_id order by x) rn from tracks)"
    + """, thin as (
  select shape_row_id, event_id, rn, x lx, y ly, true keep from numbered where rn = 1
  union all
  select n.shape_row_id, n.event_id, n.rn, case when (n.x - t.lx) * (n.x - t.lx) + (n.y - t.ly) * (n.y - t.ly) < 4 then t.lx else n.x end,
    case when (n.x - t.lx) * (n.x - t.lx) + (n.y - t.ly) * (n.y - t.ly) < 4 then t.ly else n.y end, not ((n.x - t.lx) * (n.x - t.lx) + (n.y - t.ly) * (n.y - t.ly) < 4)
  from numbered n join thin t on n.shape_row_id = t.shape_row_id and n.rn = t.rn + 1
) select shape_row_id, event_id from thin where keep"""
)


@query()
def thin_euclid(spark, d):
    t = tracks(spark, d).withColumn("y", F.col("y") / 20)
    return shapes.thin_parts(t, ["shape_row_id"], "x", 2.0, euclid=True).select("shape_row_id", "event_id")


@query("select c_custkey, row_number() over (order by c_nationkey desc, c_custkey) place from customer")
def sort_stable(spark, d):
    """The place of each row in a sort by one column that leaves equal rows in their order."""
    return tables.number_in_order(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("c_nationkey").desc(), "c_custkey", name="place").drop("c_nationkey")


@query("select event_id, case when k <= 26 then 'first' else 'last' end part from (select event_id, row_number() over (order by ts, event_id) k, count(*) over () n from events) where k <= 26 or k = n")
def inspect_rows(spark, d):
    e = table(spark, d, "events").select("ts", "event_id")
    w = Window.orderBy("ts", "event_id")
    return A.first_and_last(e, ["ts", "event_id"]).select("event_id", F.when(F.row_number().over(w) <= 26, "first").otherwise("last").alias("part"))


@query("select t.id, coalesce(a.id, 0) address_id from (select *, 'Customer#' || lpad(cast(address_id * 2 as varchar), 9, '0') location2 from tickets) t left join addresses a on a.full_address = t.location2", "tickets", "addresses")
def address_or_zero(spark, d):
    t = tickets(spark, d).drop("address_id").join(table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id"), "id")
    t = t.select("id", F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 2).cast("string"), 9, "0")).alias("location2"))
    found = joins.lookup(t, addresses(spark, d).withColumnRenamed("id", "a_id"), "location2", "full_address", {"a_id": "address_id"}, ["a_id"])
    return found.select("id", F.coalesce("address_id", F.lit(0)).alias("address_id"))


@query("select t.id, coalesce(a.id, -1) address_id from (select id, case when id % 2 = 0 then '  CUSTOMER#' else 'Customer#' end || lpad(cast(address_id as varchar), 9, '0') || ' ' location2 from tickets) t left join addresses a on upper(trim(a.full_address)) = trim(t.location2)", "tickets", "addresses")
def address_normalised(spark, d):
    """The address is trimmed and in capitals, the ticket's text only trimmed: small letters find nothing."""
    text = F.concat(F.when(F.col("id") % 2 == 0, "  CUSTOMER#").otherwise("Customer#"), F.lpad(F.col("address_id").cast("string"), 9, "0"), F.lit(" "))
    t = tickets(spark, d).select("id", text.alias("location2"))
    a = addresses(spark, d).select(F.col("id").alias("a_id"), F.upper(F.trim("full_address")).alias("address"))
    found = joins.lookup(t, a, F.trim("location2"), "address", {"a_id": "address_id"}, ["a_id"])
    return found.select("id", F.coalesce("address_id", F.lit(-1)).alias("address_id"))


@query(
    """, v as (select grp shape, row_number() over (partition by grp order by row_id) - 1 vertex, row_id, x, y from points)
  select row_id, shape, vertex, round(distance, 6) distance from (select p.row_id, v.shape, v.vertex, sqrt(pow(p.x - v.x, 2) + pow(p.y - v.y, 2)) distance,
  row_number() over (partition by p.row_id order by sqrt(pow(p.x - v.x, 2) + pow(p.y - v.y, 2)), v.row_id) rn from points p join v on p.row_id <> v.row_id) where rn = 1""",
    "points",
)
def nearest_vertex(spark, d):
    """The shape and the place in it of the nearest vertex of any shape."""
    p = points(spark, d)
    w = Window.partitionBy("grp").orderBy("row_id")
    v = p.select(F.col("row_id").alias("nearest"), F.col("grp").alias("shape"), (F.row_number().over(w) - 1).cast("long").alias("vertex"))
    return joins.nearest(p, p, "row_id", "row_id", 0.02, same_layer=True).join(v, "nearest").select("row_id", "shape", "vertex", _r("distance").alias("distance"))


SQL["nearest_vertex"] = SQL["nearest_vertex"].replace(") , v", "), v")


@query(
    """, seg as (select * from (select row_id segment_id, (grp + 1) % 5 street, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from points window w as (partition by grp order by row_id)) where x2 is not null),
  near as (select p.row_id, p.x, p.y, p.grp % 5 <> street other, segment_id, x1, y1, x2, y2, greatest(0.0, least(1.0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) t from points p, seg),
  gap as (select *, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) d from near),
  best as (select * from (select *, row_number() over (partition by row_id order by other, d, segment_id) rn from gap where d <= 0.02) where rn = 1)
  select p.row_id, coalesce(b.segment_id, -1) segment_id, round(d, 6) distance from points p left join best b using (row_id)""",
    "points",
)
def snap_to_street(spark, d):
    """The nearest stretch of the point's own street, or of any if it has none in reach."""
    own = points(spark, d).withColumn("street", F.col("grp") % 5)
    streets = _segments(spark, d).join(points(spark, d).select(F.col("row_id").alias("segment_id"), ((F.col("grp") + 1) % 5).alias("street")), "segment_id")
    s = joins.snap_to_segments(own, streets, "row_id", 0.02, 0.05, prefer="street")
    return s.select("row_id", F.coalesce("segment_id", F.lit(-1)).alias("segment_id"), _r("distance").alias("distance"))


SQL["snap_to_street"] = SQL["snap_to_street"].replace(") , seg", "), seg")


@query(
    """, seg as (select * from (select row_id segment_id, (grp + 1) % 5 street, x x1, y y1, lead(x) over w x2, lead(y) over w y2 from points window w as (partition by grp order by row_id)) where x2 is not null),
  near as (select p.row_id, p.x, p.y, p.grp % 5 <> street other, segment_id, x1, y1, x2, y2, greatest(0.0, least(1.0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) t from points p, seg),
  foot as (select *, x1 + t * (x2 - x1) fx, y1 + t * (y2 - y1) fy from near),
  gap as (select *, sqrt(pow(x - fx, 2) + pow(y - fy, 2)) d from foot),
  best as (select * from (select *, row_number() over (partition by row_id order by other, d, segment_id) rn from gap where d <= 0.02) where rn = 1)
  select p.row_id, round(coalesce(fx, p.x), 6) x, round(coalesce(fy, p.y), 6) y, coalesce(b.segment_id, -1) segment_id, case when d >= 1e-9 then round(atan2(p.y - fy, p.x - fx), 6) else 0.0::double end angle,
    case when p.grp % 5 in (1, 3) then 0.0004::double else 0.0002::double end road_width from points p left join best b using (row_id)""",
    "points",
)
def move_to_street(spark, d):
    """Points on their street, with the way back and the width of the road, twice for two of the streets."""
    own = points(spark, d).withColumn("street", F.col("grp") % 5)
    streets = _segments(spark, d).join(points(spark, d).select(F.col("row_id").alias("segment_id"), ((F.col("grp") + 1) % 5).alias("street")), "segment_id")
    s = joins.move_to_street(own, streets, "row_id", 0.02, 0.05, "street", wide=(1, 3))
    return s.select("row_id", _r("x").alias("x"), _r("y").alias("y"), F.coalesce("segment_id", F.lit(-1)).alias("segment_id"), _r("angle").alias("angle"), "road_width")


SQL["move_to_street"] = SQL["move_to_street"].replace(") , seg", "), seg")


# Sequences and shapes, continued


@query("select event_id, cast(seq as int) seq, round(x, 6) x, round(y - 100 * seq, 6) y from tracks, (select unnest(range(2)) seq)", "tracks")
def trip_markers(spark, d):
    return sequences.trip_markers(tracks(spark, d), ["shape_row_id"], ["event_id"]).select("event_id", "seq", _r("x").alias("x"), _r("y").alias("y"))


@query(
    """, p as (select *, row_number() over (partition by grp order by row_id) k, count(*) over (partition by grp) n, least(max(x) over (partition by grp) - min(x) over (partition by grp), max(y) over (partition by grp) - min(y) over (partition by grp)) / 10 r from points)
  select row_id, cast(seq as int) seq, round(x + cos(seq * 0.1) * r, 6) x, round(y + sin(seq * 0.1) * r, 6) y from p, (select unnest(range(63)) seq) where k = 1 or k = n""",
    "points",
)
def highlight_vertex(spark, d):
    return sequences.highlight_vertices(points(spark, d), ["grp"], "row_id").select("row_id", "seq", _r("x").alias("x"), _r("y").alias("y"))


SQL["highlight_vertex"] = SQL["highlight_vertex"].replace(") , p as", "), p as")


@query(
    """, i as (select *, case when floor(y / 50) is distinct from lag(floor(y / 50)) over w then 1 else 0 end new from tracks window w as (partition by shape_row_id order by x)),
  r as (select *, sum(new) over (partition by shape_row_id order by x) run from i)
  select shape_row_id, cast(run as bigint) run, count(*) vertices, min(event_id) first_event, max(event_id) last_event from (select *, row_number() over (partition by shape_row_id, run order by x) from r) group by 1, 2""",
    "tracks",
)
def shapes_from_runs(spark, d):
    """One shape per run of equal ids, with its vertices as an array."""
    t = tables.islands(tracks(spark, d).withColumn("id", F.floor(F.col("y") / 50)), ["id"], ["x"], within=["shape_row_id"])
    a = tables.runs_to_arrays(t, ["shape_row_id", "run"], "x", ["y", "event_id"])
    ids = F.transform("points", lambda p: p["event_id"])
    return a.select("shape_row_id", "run", F.size("points").cast("long").alias("vertices"), F.array_min(ids).alias("first_event"), F.array_max(ids).alias("last_event"))


SQL["shapes_from_runs"] = SQL["shapes_from_runs"].replace(") , i as", "), i as")

_DFT = """with v as (select vec_id, unnest(range(len(embedding))) j, cast(unnest(embedding) as double) v, len(embedding) n from embeddings),
  f as (select vec_id, h, sqrt(pow(sum(v * cos(2 * pi() * h * j / n)), 2) + pow(sum(v * sin(2 * pi() * h * j / n)), 2)) m from v, (select unnest(range(1000)) h) where h < {size} group by 1, 2)
  select vec_id, cast(h as int) k, round(m, 4) magnitude from f"""


@query(_DFT.format(size="n // 2 + 1"))
def fft_magnitude(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v"))
    return spectra.magnitudes(e, "vec_id", "j", "v").withColumn("magnitude", _r("magnitude", 4))


@query(_DFT.format(size="n"))
def fft_inverse(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v"))
    return spectra.magnitudes(e, "vec_id", "j", "v", inverse=True).withColumn("magnitude", _r("magnitude", 4))


@query(
    """with g as (select event_id, value, event_id // 100 as line, event_id % 100 as place from events), s as (select event_id, value z, coalesce(lead(value) over r, value) - coalesce(lag(value) over r, value) + coalesce(lead(value) over c, value) - coalesce(lag(value) over c, value) slope
  from g window r as (partition by line order by place), c as (partition by place order by line))
  select event_id, round(case when z < 0 then 0 when z < 100 then z / 100 else 1 end * greatest(0, least(1, 1 - 0.5 * atan(slope / 100) / (pi() / 2))), 6) red from s"""
)
def hill_shading(spark, d):
    """The events in lines of a hundred: every inner cell has neighbours on four sides."""
    grid = table(spark, d, "events").select("event_id", F.expr("event_id div 100").alias("row"), (F.col("event_id") % 100).alias("col"), F.col("value").alias("z"))
    lit = files.elevation_colours(grid, [(0.0, 0.0, 0.0, 0.0), (100.0, 1.0, 1.0, 1.0)])
    return lit.select("event_id", _r("red").alias("red"))


@query("select cast(seq as bigint) seq, case when seq in (1, 2) then 3.0::double else 1.0 end x, case when seq >= 2 then 4.0::double else 2.0 end y from (select unnest(range(4)) seq)")
def generate_square(spark, d):
    return generate.square(spark, 2.0, 3.0, 1.0).select("seq", "x", "y")


@query("select 1000::bigint n, 1000::bigint places, true inside")
def generate_random(spark, d):
    """A thousand points, all apart and in the unit square."""
    p = generate.random_points(spark, 1000, 11)
    return p.agg(F.count("*").alias("n"), F.count_distinct("x", "y").alias("places"), F.bool_and(F.expr("x between 0 and 1 and y between 0 and 1")).alias("inside"))


# Sources and functions of users, continued


@query("select id, x, y, case when count(*) over (partition by id) > 1 then 'line_strip' else 'points' end shape_type from (select cast(grp as varchar) id, x, y from points)", "points")
def xy_id_round_trip(spark, d):
    path = _folder(spark)
    points(spark, d).select(F.concat_ws(" ", "x", "y", "grp").alias("value")).write.text(path)
    return delimited.read_points(spark, path).select("id", "x", "y", "shape_type")


@query("select c_custkey, c_name, c_mktsegment || ', \"x\"' note from customer")
def csv_fast_round_trip(spark, d):
    path = f"{_folder(spark)}.csv"
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit(', "x"')).alias("note"))
    writers.write_csv(c, path, order=["c_custkey"])
    return delimited.read_fast(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "note")


@query("select grp, count(*) n, round(sum(x), 3) sx, round(sum(y), 3) sy from points group by 1", "points")
def svg_round_trip(spark, d):
    """A drawing per group, its outline one path."""
    path = _folder(spark)
    step = F.concat(F.when(F.col("k") == 0, "M").otherwise("L"), F.format_string("%.6f %.6f", "p.x", "p.y"))
    outline = tables.runs_to_arrays(points(spark, d), ["grp"], "row_id", ["x", "y"]).select("grp", F.posexplode("points").alias("k", "p")).select("grp", "k", step.alias("s"))
    paths = tables.runs_to_arrays(outline, ["grp"], "k", ["s"]).select("grp", F.array_join(F.transform("points", lambda p: p["s"]), " ").alias("d"))
    text = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><text id="g'), "grp", F.lit('"/><path fill="#'), F.lpad(F.hex("grp"), 6, "0"), F.lit('" d="'), "d", F.lit('"/></svg>'))
    paths.select("grp", text.alias("value")).repartition("grp").write.partitionBy("grp").text(path)
    back = files.read_svg(spark, f"{path}/*/*.txt").withColumn("grp", F.round(F.col("blue") * 255).cast("int"))
    return back.groupBy("grp").agg(F.count("*").alias("n"), _r(F.sum("x"), 3).alias("sx"), _r(F.sum("y"), 3).alias("sy"))


@query("select cast(c_custkey as bigint) id, c_name name, '' note, -1 size from customer union all select cast(s_suppkey as bigint), s_name, 'supplier', cast(s_nationkey + 5 as int) from supplier")
def schema_evolution(spark, d):
    """A second batch brings columns that the first did not have."""
    path = _folder(spark)
    writers.append_evolving(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name")), path)
    more = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("note"), (F.col("s_nationkey") + 5).cast("int").alias("size"))
    return writers.append_evolving(more, path).select("id", "name", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("size", F.lit(-1)).alias("size"))


@query("select c_nationkey, round(exp(avg(ln(c_acctbal + 2000))), 4) middle from customer group by 1")
def udaf_geometric_mean(spark, d):
    mean = templates.aggregate(lambda v: float(np.exp(np.log(v).mean())))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(_r(mean((F.col("c_acctbal") + 2000).cast("double")), 4).alias("middle"))


@query("select p_partkey, cast(unnest(range(len(w))) as int) place, unnest(w) part from (select p_partkey, string_split(p_type, ' ') w from part)")
def udtf_split_text(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type")
    return p.lateralJoin(templates.SplitText(F.col("p_type").outer(), F.lit(" "))).select("p_partkey", "place", "part")


@query("select grp, count(*) n, round(sum(x), 4) sx from points group by 1", "points")
def map_shapes(spark, d):
    """A user's function over each shape as a pandas frame."""
    own = points(spark, d)
    return tables.map_groups(own, ["grp"], lambda f: pd.DataFrame({"grp": [f["grp"].iloc[0]], "n": [len(f)], "sx": [round(f["x"].sum(), 4)]}), f"grp {own.schema['grp'].dataType.simpleString()}, n long, sx double")
