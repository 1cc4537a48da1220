"""Prefix scans over range-partitioned tables: running sums, row numbers and runs of a sequence that no task holds whole.

The table is put in order by ranges. Each range works out its own sums and hands on its state (totals per group, last
ids); the states, a row for each range and group that crosses its border, give every range its offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.session import stored

PART, PLACE = "__part", "__place"


def in_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` in ranges of ``order``, with the number of its range and its place there; rows that tie are spread too."""
    salted = df.withColumn("__salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*order, "__salt").sortWithinPartitions(*order, "__salt").drop("__salt")
    return stored(ranged.withColumns({PART: F.spark_partition_id().cast("long"), PLACE: F.monotonically_increasing_id()}))


def _offsets(ranged: DataFrame, values: Mapping[str, Column], within: Sequence[str]) -> DataFrame:
    """(range, group, __has_..., __from_...): what the ranges before hold of a group that goes on there."""
    totals = ranged.groupBy(PART, *within).agg(*[F.sum(v).alias(k) for k, v in values.items()])
    if within:
        earlier = Window.partitionBy(*within).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        found = totals.select(PART, *within, *[F.sum(k).over(earlier).alias(f"__from_{k}") for k in values], F.count("*").over(earlier).alias("__n")).where("__n > 0").drop("__n")
    else:  # a row for each range: one array, folded
        states = totals.agg(F.array_sort(F.collect_list(F.struct(PART, *values))).alias("s"))
        rest = states.select(F.posexplode("s").alias("i", "e"), "s").where("i > 0").select(F.col(f"e.{PART}").alias(PART), F.expr("slice(s, 1, i)").alias("b"))
        kinds = dict(totals.dtypes)
        total = lambda k: F.aggregate("b", F.lit(0).cast(kinds[k]), lambda a, x: a + F.coalesce(x[k], F.lit(0)).cast(kinds[k]))
        found = rest.select(PART, *[total(k).alias(f"__from_{k}") for k in values])
    return found.withColumnsRenamed({c: f"__of_{c}" for c in (PART, *within)})


def _with_offsets(ranged: DataFrame, values: Mapping[str, Column], within: Sequence[str]) -> DataFrame:
    offsets = _offsets(ranged, values, within)  # at most one group crosses each border
    on = F.col(PART) == F.col(f"__of_{PART}")
    for c in within:
        on &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    own = Window.partitionBy(PART, *within).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"__own_{k}": F.sum(v).over(own) for k, v in values.items()})
    joined = summed.join(F.broadcast(offsets), on, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    names = {k: zero(f"__own_{k}") + zero(f"__from_{k}") for k in values}
    spare = [c for c in joined.columns if c.startswith(("__own_", "__from_", "__of_"))]
    return joined.withColumns(names).drop(*spare)


def running_sums(df: DataFrame, sums: Mapping[str, Column], order: Sequence[str | Column], within: Sequence[str] = ()) -> DataFrame:
    """Adds sums of the given columns up to each row in ``order``, within each group of ``within`` or over the whole table.

    A group may be of any size: a task holds a range of the order, not a group. Nulls count as 0.
    """
    ranged = in_ranges(df, [*within, *order])
    return _with_offsets(ranged, sums, within).drop(PART, PLACE)


def numbered(df: DataFrame, order: Sequence[str | Column], within: Sequence[str] = (), name: str = "number") -> DataFrame:
    """Numbers the rows 1, 2, 3 ... in ``order``, within each group of ``within``."""
    return running_sums(df, {name: F.lit(1).cast("long")}, order, within)


def runs(df: DataFrame, ids: Sequence[str], order: Sequence[str | Column], name: str = "run") -> DataFrame:
    """Numbers the maximal runs of equal ``ids`` of the whole table from 1, in ``order``."""
    ranged = in_ranges(df, order)
    last = ranged.groupBy(PART).agg(F.max_by(F.struct(*ids), PLACE).alias("last"))
    states = last.agg(F.array_sort(F.collect_list(F.struct(F.col(PART).alias("p"), "last"))).alias("s"))
    before = states.select(F.posexplode("s").alias("k", "e"), "s").where("k > 0").select(F.col("e.p").alias("__of_part"), F.expr("s[k - 1].last").alias("__last"))
    own = Window.partitionBy(PART).orderBy(PLACE)
    joined = ranged.withColumn("__prev", F.lag(F.struct(*ids)).over(own)).join(F.broadcast(before), F.col(PART) == F.col("__of_part"), "left")
    earlier = F.coalesce("__prev", "__last")
    changed = earlier.isNull()
    for c in ids:
        changed |= ~F.col(c).eqNullSafe(earlier[c])
    flagged = joined.withColumn("__new", changed.cast("long")).drop("__prev", "__last", "__of_part")
    return _with_offsets(flagged, {name: F.col("__new")}, ()).drop("__new", PART, PLACE)
