"""Reports, activity totals and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scalars as S

# Infraction codes of meters, symbols of rising counts.
METER_CODES = (1, 207, 210, 312)
SYMBOLS = " .,-=+*%0#"
SLOTS = 48


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def first_and_last(df: DataFrame, order: Sequence[str], n: int = 26) -> DataFrame:
    """The first ``n`` rows and the last one, as a report of what a table holds; no row twice."""
    first = df.orderBy(*order).limit(n)
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(1)
    return first.union(last).distinct()


def bounds_report(df: DataFrame) -> DataFrame:
    """One row per column: low and high of numbers, or the longest text and how many have that length.

    Numbers and longest texts take one scan; the counts of the longest take a second one, as histograms of lengths.
    """
    parts = []
    for f in df.schema:
        if isinstance(f.dataType, T.NumericType):
            parts.append(F.struct(F.lit(f.name).alias("name"), F.min(f.name).cast("double").alias("low"), F.max(f.name).cast("double").alias("high"), F.lit(None).cast("int").alias("longest"), F.lit(None).cast("long").alias("n_longest")))
        elif isinstance(f.dataType, T.StringType):
            # counts per length stay small: a map-side histogram, of which the last entry is read
            longest = F.max(F.struct(F.length(f.name).alias("l")))["l"]
            parts.append(F.struct(F.lit(f.name).alias("name"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), longest.alias("longest"), F.lit(None).cast("long").alias("n_longest")))
    report = df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return report
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.length(c).alias("l")) for c in texts])).alias("x"))
    counts = each.groupBy("x.name", "x.l").agg(F.count("*").alias("n")).groupBy("name").agg(F.max_by("n", "l").alias("n"))
    return report.drop("n_longest").join(F.broadcast(counts), "name", "left").withColumnRenamed("n", "n_longest")


def bbox_polygon(df: DataFrame, keys: Sequence[str] = (), border: float = 0.0) -> DataFrame:
    """The four corners of the bounds, of the table or each shape, widened by ``border`` of the range in all."""
    b = df.groupBy(*keys).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    wide, tall = (F.col("b") - F.col("a")) * border / 2, (F.col("d") - F.col("c")) * border / 2
    x0, x1, y0, y1 = F.col("a") - wide, F.col("b") + wide, F.col("c") - tall, F.col("d") + tall
    corners = F.array(*[F.struct(F.lit(k).alias("corner"), x.alias("x"), y.alias("y")) for k, (x, y) in enumerate(((x0, y0), (x1, y0), (x1, y1), (x0, y1)))])
    return b.select(*keys, F.explode(corners).alias("p")).select(*keys, "p.*")


def is_opposite(location: Column) -> Column:
    return F.when(location.isin("OP", "OPP"), 1).otherwise(0)


def ticket_totals(addresses: DataFrame, tickets: DataFrame, now_weekday: int, now_minute: int, hours: Sequence[int] = (1, 3, 6)) -> DataFrame:
    """Per address, sixteen counts: at or opposite, other or meter; all, and strictly within each of the next hours.

    A window that passes midnight looks at the next day only, up to its end. One aggregation of the tickets, with
    partial counts, then a join of totals: tickets never meet addresses row by row.
    """
    opp, meter = is_opposite(F.col("location1")) == 1, F.col("infraction_code").isin(*METER_CODES)
    day, minute = S.weekday(F.col("date_of_infraction")), S.minute_of_day(F.col("time_of_infraction"))

    def within(h: int) -> Column:
        span = h * 60
        if now_minute + span <= 1440:
            return (day == now_weekday) & (minute > now_minute) & (minute < now_minute + span)
        return (day == (now_weekday + 1) % 7) & (minute > now_minute - 1440) & (minute < now_minute - 1440 + span)

    counts = []
    for side, at in (("at", ~opp), ("op", opp)):
        for kind, which in (("tickets", ~meter), ("meter_tickets", meter)):
            counts.append(F.count_if(at & which).alias(f"num_{side}_{kind}"))
            counts += [F.count_if(at & which & within(h)).alias(f"num_{side}_{kind}_within_{h}h") for h in hours]
    totals = tickets.groupBy(F.col("address_id").alias("__id")).agg(*counts)
    joined = addresses.join(totals, F.col("id") == F.col("__id"), "left").drop("__id")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in totals.columns if c != "__id"})


def totals_by_weekday(tickets: DataFrame, key: str) -> DataFrame:
    """Tickets, fines and a count per weekday (Sunday first) of each key."""
    day = S.weekday(F.col("date_of_infraction"))
    return tickets.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum("set_fine_amount"), 2).alias("fines"), *[F.count_if(day == k).alias(f"wday_{k}") for k in range(7)])


def totals_by_side(tickets: DataFrame, key: str) -> DataFrame:
    opp = is_opposite(F.col("location1"))
    return tickets.groupBy(key).agg(F.count_if(opp == 0).alias("num_at"), F.count_if(opp == 1).alias("num_op"))


def half_hour_histogram(tickets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group, all counts and an array of 48 half-hour counts: counted per slot first, then laid out."""
    slots = tickets.withColumn("__slot", S.half_hour(F.col("time_of_infraction"))).where("__slot is not null")
    counted = slots.groupBy(*keys, "__slot").agg(F.count("*").alias("__n"))
    laid = counted.groupBy(*keys).agg(F.sum("__n").alias("tickets_all_day"), F.map_from_entries(F.collect_list(F.struct("__slot", "__n"))).alias("__m"))
    return laid.withColumn("slots", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.coalesce(F.element_at("__m", s), F.lit(0)))).drop("__m")


def as_printable(slots: Column) -> Column:
    """One character per slot: chr(32 + count), full at 126."""
    return F.array_join(F.transform(slots, lambda n: F.char((32 + F.least(n, F.lit(94))).cast("int"))), "")


def as_symbols(slots: Column) -> Column:
    """One of ten symbols per slot, by the count's share of the largest."""
    most = F.greatest(F.array_max(slots), F.lit(1))
    return F.array_join(F.transform(slots, lambda n: F.substring(F.lit(SYMBOLS), F.floor(n / most * 9).cast("int") + 1, F.lit(1))), "")


def merge_printable(a: Column, b: Column) -> Column:
    """Two printable histograms added slot by slot, full at 126."""
    chars = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x) - 32)
    return as_printable(F.zip_with(chars(a), chars(b), lambda x, y: x + y))


def next_slots(printable: Column, tomorrow: Column, first: int, n: int = 6) -> Column:
    """``n`` slots from ``first`` on, going on into the next day's histogram."""
    today = F.rpad(F.coalesce(printable, F.lit("")), SLOTS, " ")
    return F.substring(F.concat(today, F.rpad(F.coalesce(tomorrow, F.lit("")), SLOTS, " ")), first + 1, n)


def with_tomorrow(histograms: DataFrame, keys: Sequence[str], day: str = "wday", column: str = "half_hourly") -> DataFrame:
    """Adds the next weekday's histogram of the same group, null if it has none or a key is null.

    The histograms are computed once: a group's days, seven at most, are collected over it.
    """
    week = F.collect_list(F.struct(F.col(day).alias("day"), F.col(column).alias("line"))).over(Window.partitionBy(*keys))
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    with_week = histograms.withColumn("__week", week)
    following = F.filter("__week", lambda x: x["day"] == (F.col(day) + 1) % 7)
    return with_week.withColumn("tomorrow", F.when(known, F.try_element_at(following, F.lit(1))["line"])).drop("__week")


def rms(df: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """Root mean square of each ``width`` consecutive values."""
    w = Window.partitionBy(key).orderBy(order)
    placed = df.withColumn("window", F.floor((F.row_number().over(w) - 1) / width))
    return placed.groupBy(key, "window").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def group_shapes(df: DataFrame, key: str, order: str) -> DataFrame:
    """All vertices of each id as one array, in order."""
    packed = F.array_sort(F.collect_list(F.struct(order, "x", "y")))
    return df.groupBy(key).agg(F.transform(packed, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
