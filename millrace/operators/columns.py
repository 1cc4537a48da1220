"""Column edits, text, scaling and colours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scalars as S


def edit_columns(df: DataFrame, remove: Sequence[str] = (), to_int: Sequence[str] = (), to_seconds: Sequence[str] = (), to_double: Sequence[str] = ()) -> DataFrame:
    """Drops and converts; the order is what is kept, then integers, times and decimals. A converted column stays."""
    converted = {*to_int, *to_seconds, *to_double}
    kept = [F.col(c) for c in df.columns if c not in converted and c not in remove]
    new = [S.as_int(F.col(c)).alias(c) for c in to_int] + [S.seconds_of_day(F.col(c)).alias(c) for c in to_seconds] + [S.as_double(F.col(c)).alias(c) for c in to_double]
    return df.select(*kept, *new)


def concat_text(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Joined by one space; a null is empty and keeps its space."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(" ")] * bool(parts) + [F.coalesce(F.col(c).cast("string"), F.lit(""))]
    return df.withColumn(name, F.concat(*parts))


def trim_spaces(df: DataFrame, *columns: str) -> DataFrame:
    """Spaces (no other white space) off both ends."""
    return df.withColumns({c: F.trim(F.col(c)) for c in columns})


def multiply(df: DataFrame, column: str, by: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * by)


def offset(df: DataFrame, column: str, by: float) -> DataFrame:
    return df.withColumn(column, F.col(column) + by)


def normalize(df: DataFrame, columns: Sequence[str], scale: float = 1.0, within: Sequence[str] = ()) -> DataFrame:
    """To [0, scale] by the column's range, over the table or each group; null where the range is empty.

    The table's range is one aggregated row that is broadcast: the rows themselves are not shuffled.
    """
    part = lambda c, low, high: F.try_divide(F.col(c) - low, high - low) * scale
    if within:
        w = Window.partitionBy(*within)
        return df.withColumns({c: part(c, F.min(c).over(w), F.max(c).over(w)) for c in columns})
    ranges = df.agg(*[f(c).alias(f"__{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    return df.join(F.broadcast(ranges)).select(*[part(c, F.col(f"__min_{c}"), F.col(f"__max_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def rescale_bounds(df: DataFrame, x0: float, y0: float, x1: float, y1: float, x: str = "x", y: str = "y") -> DataFrame:
    """Maps the data's bounds onto the rectangle (x0, y0) to (x1, y1)."""
    return normalize(df, [x, y]).withColumns({x: x0 + F.col(x) * (x1 - x0), y: y0 + F.col(y) * (y1 - y0)})


def transform(df: DataFrame, offsets: Mapping[str, float], scales: Mapping[str, float]) -> DataFrame:
    """Offset, then scale, each column."""
    return df.withColumns({c: (F.col(c) + offsets.get(c, 0.0)) * scales.get(c, 1.0) for c in {**offsets, **scales}})


COLOUR = ("red", "green", "blue", "alpha")


def colour_by_rules(df: DataFrame, rules: DataFrame, column: str, order: str = "rule") -> DataFrame:
    """Colours of the last rule for the column's value; black and opaque without one.

    Rules are reduced to one row per value first, so rows are never multiplied.
    """
    last = rules.groupBy(F.col(column).alias("__value")).agg(F.max_by(F.struct(*COLOUR), order).alias("__c"))
    default = dict(zip(COLOUR, (0.0, 0.0, 0.0, 1.0)))
    joined = df.join(last, F.col(column) == F.col("__value"), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__c.{c}"), F.lit(d)) for c, d in default.items()}).drop("__value", "__c")


def random_colours(df: DataFrame, seed: int, within: Sequence[str] = ()) -> DataFrame:
    """A colour per row, or per shape with ``within``, from a hash of the seed and the row's key: reproducible."""
    key = list(within) or df.columns
    part = lambda k: (F.pmod(F.xxhash64(F.lit(seed * 3 + k), *key), F.lit(1 << 20)) / float(1 << 20))
    return df.withColumns({"red": part(0), "green": part(1), "blue": part(2), "alpha": F.lit(1.0)})


def grayscale(df: DataFrame) -> DataFrame:
    grey = S.luma(F.col("red"), F.col("green"), F.col("blue"))
    return df.withColumns({"red": grey, "green": grey, "blue": grey})


def colour_by_number(df: DataFrame, column: str) -> DataFrame:
    """Grey by the value's place in the column's range."""
    return normalize(df.withColumn("red", F.col(column).cast("double")), ["red"]).withColumns({"green": F.col("red"), "blue": F.col("red"), "alpha": F.lit(1.0)})


def replace_colours(df: DataFrame, changes: Sequence[tuple[tuple[float, float, float], tuple[float, float, float]]], tolerance: float = 1e-3) -> DataFrame:
    """Each colour given as (from, to) is replaced; the first match counts."""
    out = F.struct("red", "green", "blue")
    for old, new in reversed(list(changes)):
        same = F.lit(True)
        for c, v in zip(COLOUR, old):
            same &= F.abs(F.col(c) - v) < tolerance
        out = F.when(same, F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(COLOUR, new)])).otherwise(out)
    return df.withColumn("__c", out).withColumns({c: F.col(f"__c.{c}") for c in COLOUR[:3]}).drop("__c")


def colour_by_activity(df: DataFrame, count: str, total: int) -> DataFrame:
    """Black with alpha .2 to 1: .8 times the count over the average per row, plus .2."""
    rows = df.agg(F.count("*").alias("__n"))
    share = F.try_divide(F.col(count) * F.col("__n"), F.lit(float(total)))
    zero = F.lit(0.0)
    return df.join(F.broadcast(rows)).withColumns({"red": zero, "green": zero, "blue": zero, "alpha": F.least(F.lit(1.0), 0.8 * share + 0.2)}).drop("__n")


def renumber(df: DataFrame, column: str) -> DataFrame:
    """Ids renumbered from 1 in their order: the distinct ids are numbered and joined back."""
    from millrace.table import number_in_order

    ids = number_in_order(df.select(F.col(column).alias("__old")).distinct(), "__old", name="__new")
    return df.join(ids, F.col(column) == F.col("__old")).withColumn(column, F.col("__new")).drop("__old", "__new")


def colour_by_cost(df: DataFrame, costs: DataFrame, key: str, cost: str) -> DataFrame:
    """Grey by the cost's share of the costs' range; red where there is none."""
    span = costs.agg((F.max(cost) - F.min(cost)).alias("__span"))
    priced = costs.groupBy(F.col(key).alias("__key")).agg(F.max(cost).alias("__cost")).join(F.broadcast(span))
    grey = F.try_divide(F.col("__cost"), F.col("__span"))
    joined = df.join(priced, F.col(key) == F.col("__key"), "left").withColumn("__grey", grey)
    other = F.coalesce("__grey", F.lit(0.0))
    return joined.withColumns({"red": F.coalesce("__grey", F.lit(1.0)), "green": other, "blue": other, "alpha": F.lit(1.0)}).drop("__key", "__cost", "__span", "__grey")


def colour_from_series(df: DataFrame, series: DataFrame, key: str, order: str) -> DataFrame:
    """Each vertex takes the colour at the same relative place of the series of its key."""
    place = lambda t: t.withColumns({"__i": F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1, "__n": F.count("*").over(Window.partitionBy(key))})
    own = place(df)
    other = place(series).select(F.col(key).alias("__key"), F.col("__i").alias("__j"), F.col("__n").alias("__m"), *[F.col(c).alias(f"__{c}") for c in COLOUR])
    sizes = other.groupBy("__key").agg(F.first("__m").alias("__m"))
    placed = own.join(sizes, F.col(key) == F.col("__key"), "left").drop("__key").withColumn("__at", F.floor(F.col("__i") * F.col("__m") / F.col("__n")))
    joined = placed.join(other.drop("__m"), (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__j")), "left")
    return joined.select(*[F.col(c) for c in df.columns if c not in COLOUR], *[F.col(f"__{c}").alias(c) for c in COLOUR])
