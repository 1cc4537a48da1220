import pytest
from pyspark.sql import functions as F

from millrace.functions import projections as P
from millrace.functions import scalars as S
from millrace.table import Table, islands, leading_int, number_rows


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, value", [("12abc", 12), (" 7", 7), ("", 0), ("x", 0), ("-3.9", -3), ("99999999999", 0), (None, 0)])
def test_leading_integer(spark, text, value):
    assert one(spark, S.as_int, text) == value
    assert leading_int("12abc") == 12


@pytest.mark.parametrize("text, value", [("1.5e3x", 1500.0), (".5", 0.5), ("abc", 0.0), (None, 0.0), ("-2.", -2.0)])
def test_leading_decimal(spark, text, value):
    assert one(spark, S.as_double, text) == value


@pytest.mark.parametrize("text, value", [("1:02:03", 3723), ("23:59:59", 86399), (None, None)])
def test_seconds(spark, text, value):
    assert one(spark, S.seconds_of_day, text) == value


def test_seconds_refuses(spark):
    with pytest.raises(Exception, match="not a time of day"):
        one(spark, S.seconds_of_day, "bad")


@pytest.mark.parametrize("hhmm, slot", [(0, 0), (29, 0), (30, 1), (2359, 47), (2400, None), (-1, None)])
def test_half_hour(spark, hhmm, slot):
    assert one(spark, S.half_hour, hhmm, "int") == slot


def test_weekday(spark):
    assert one(spark, S.weekday, 20240107, "int") == 0
    assert one(spark, lambda c: S.weekday(c, "monday"), 20240107, "int") == 6
    assert one(spark, S.weekday, 20241399, "int") is None


def test_text(spark):
    assert one(spark, S.as_text, 1.5, "double") == "1.500000"


def test_utm_of_the_central_meridian(spark):
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(P.to_lon_lat(F.lit(500000.0), F.lit(0.0), F.lit(17), P.Grid.of("wgs84")), ("lon", "lat"))]).first()
    assert row["lon"] == pytest.approx(-81) and row["lat"] == pytest.approx(0)


def test_out_of_range_is_null(spark):
    row = spark.range(1).select(*P.to_lon_lat(F.lit(1.0), F.lit(0.0), F.lit(17), P.Grid.of())).first()
    assert row[0] is None


@pytest.mark.parametrize("lon, lat, zone", [(-79.4, 43.7, 17), (5.0, 60.0, 32), (10.0, 75.0, 33), (35.0, 75.0, 37)])
def test_utm_zones(spark, lon, lat, zone):
    assert spark.range(1).select(P.utm_zone(F.lit(lon), F.lit(lat))).first()[0] == zone


@pytest.mark.parametrize("lon, lat, zone", [(-79.4, 43.7, 10), (-79.4, 47.5, 10), (-80.0, 47.5, 12), (-82.0, 45.0, 11), (-53.0, 47.0, 1), (-74.0, 45.0, 8), (-123.0, 49.0, 26), (0.0, 51.0, None), (-85.0, 45.0, 13), (-63.5, 44.0, 5), (-66.2, 45.0, 6), (-142.0, 60.0, 32)])
def test_mtm_zones(spark, lon, lat, zone):
    assert spark.range(1).select(P.mtm_zone(F.lit(lon), F.lit(lat))).first()[0] == zone


@pytest.mark.parametrize("lat, letter", [(43.7, "T"), (84.0, "X"), (-80.0, "C"), (0.0, "N"), (-1.0, "M"), (85.0, "Z")])
def test_zone_letters(spark, lat, letter):
    assert spark.range(1).select(P.zone_letter(F.lit(lat))).first()[0] == letter


def test_islands(spark):
    df = spark.createDataFrame([(k, i) for k, i in enumerate([1, 1, 2, 1, 1])], "seq int, id int")
    assert [r["run"] for r in islands(df, ["id"], ["seq"]).orderBy("seq").collect()] == [1, 1, 2, 3, 3]


def test_attributes(spark):
    t = Table(number_rows(spark.range(3).toDF("v")), (("a", 1), ("a", 2), ("b", "7x")))
    assert t.attr("a") == 1 and t.drop_attrs("a").attr("a") is None
    assert t.int_attrs("b").attr("b") == 7 and t.set_attr("a", 5).attrs[0] == ("a", 5) and t.set_attr("c", 1).attr("c") == 1
    assert t.pipe(lambda df: df.where("v > 0")).df.count() == 2
