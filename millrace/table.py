"""Ordered tables with attributes: a DataFrame, its order column and a list of (name, value) pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = "__row"
BLOCK = "__block"


@dataclass(frozen=True)
class Table:
    """Rows in the order of ``order``; ``attrs`` may repeat a name, the first one counts."""

    df: DataFrame
    attrs: Sequence[tuple[str, object]] = field(default_factory=tuple)
    order: str = ROW

    def attr(self, name: str, default=None):
        return next((v for k, v in self.attrs if k == name), default)

    def with_attr(self, name: str, value) -> Table:
        return replace(self, attrs=(*self.attrs, (name, value)))

    def set_attr(self, name: str, value) -> Table:
        """Replaces the first value of that name, or adds it."""
        if self.attr(name, self) is self:
            return self.with_attr(name, value)
        at = next(i for i, (k, _) in enumerate(self.attrs) if k == name)
        return replace(self, attrs=(*self.attrs[:at], (name, value), *self.attrs[at + 1 :]))

    def drop_attrs(self, *names: str) -> Table:
        return replace(self, attrs=tuple((k, v) for k, v in self.attrs if k not in names))

    def int_attrs(self, *names: str) -> Table:
        """Attributes read as leading integers, 0 where there is none."""
        return replace(self, attrs=tuple((k, leading_int(v)) if k in names else (k, v) for k, v in self.attrs))

    def pipe(self, fn: Callable[[DataFrame], DataFrame], *args, **kwargs) -> Table:
        return replace(self, df=fn(self.df, *args, **kwargs))


def leading_int(value) -> int:
    import re

    found = re.match(r"\s*([+-]?\d+)", str(value))
    return int(found[1]) if found else 0


def number_rows(df: DataFrame, name: str = ROW) -> DataFrame:
    """A row number that rises in the order of the input's partitions; gaps are allowed, so nothing is shuffled."""
    return df.withColumn(name, F.monotonically_increasing_id())


def number_in_order(df: DataFrame, *order: str | Column, name: str = ROW) -> DataFrame:
    """Numbers the rows 1, 2, 3 ... in ``order`` without putting them in one partition.

    Ranges are sorted where they are, and each gets the count of those before it: one row per partition.
    """
    from millrace.plans.session import checkpointed

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    placed = checkpointed(ranged.withColumn("__k", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33)))
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    return placed.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + F.col("__k") + 1).drop("__p", "__k", "__before")


def islands(df: DataFrame, ids: Sequence[str], order: Sequence[str | Column], name: str = "run", within: Sequence[str] = ()) -> DataFrame:
    """Numbers the maximal runs of equal ``ids`` from 1, in ``order`` within each group of ``within``.

    A run ends wherever an id changes, so 1, 1, 2, 1 has three. Without ``within`` the whole table is one sequence, put
    in order by ranges (``operators.scans``).
    """
    if not within:
        from millrace.operators import scans

        return scans.runs(df, ids, order, name)
    w = Window.partitionBy(*within).orderBy(*order)
    changed = F.lag(F.lit(1)).over(w).isNull()
    for c in ids:
        changed |= ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("__new", changed.cast("int")).withColumn(name, F.sum("__new").over(w).cast("long")).drop("__new")


def runs_to_arrays(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], name: str = "points") -> DataFrame:
    """One row per group with its rows' ``fields`` as an array of structs in ``order``."""
    packed = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return df.groupBy(*keys).agg(packed.alias(name))


def map_groups(df: DataFrame, keys: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """``fn`` (pandas frame to pandas frame) on each group: the place for ring algorithms that SQL cannot express."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
