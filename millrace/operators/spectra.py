"""Fourier spectra of series of any length as Spark plans: low frequencies by sums, whole transforms in two steps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import scans

#: A remainder of the energy below this share of it is rounding, and counts as nothing.
NOTHING = 1e-12


def _placed(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, i, v, n): each value's place from 0 in its series, and the series' length; a null value is 0."""
    values = df.select(F.col(key).alias("key"), F.col(order).alias("__order"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    numbered = scans.numbered(values, ["__order"], ["key"], "i").select("key", (F.col("i") - 1).alias("i"), "v")
    lengths = numbered.groupBy(F.col("key").alias("__of")).agg(F.count("*").alias("n"))
    return numbered.join(lengths, F.col("key").eqNullSafe(F.col("__of"))).drop("__of")


def low_share(df: DataFrame, key: str, order: str, value: str, width: int, cut: int) -> DataFrame:
    """(key, window, ratio): over windows that overlap by half, the energy below the ``cut``-th frequency over that above.

    A series shorter than ``width`` is one window. Only the low frequencies and the highest one are summed, which one
    aggregation does for all windows; the energy of the others is what the sum of squares leaves. Without any, the ratio is 0.
    """
    c, half = F.col, width // 2
    first = F.greatest(F.lit(0), F.ceil((c("i") - width + 1) / half)).cast("long")
    spread = _placed(df, key, order, value).withColumn("window", F.explode(F.sequence(first, F.floor(c("i") / half).cast("long"))))
    held = spread.where((c("window") == 0) & (c("i") < width) | (c("window") > 0) & (c("window") * half + width <= c("n")))
    turn = 2 * math.pi * (c("i") - c("window") * half) / F.least(c("n"), F.lit(width))
    sums = [F.pow(F.sum(c("v") * wave(h * turn)), 2).alias(f"p{2 * h + side}") for h in range(cut) for side, wave in enumerate((F.cos, F.sin))]
    other = F.when((c("i") - c("window") * half) % 2 == 0, c("v")).otherwise(-c("v"))
    found = held.groupBy("key", "window").agg(F.count("*").alias("m"), F.sum(c("v") * c("v")).alias("squares"), F.pow(F.sum("v"), 2).alias("mean"), F.pow(F.sum(other), 2).alias("top"), *sums)
    low = sum((F.when(F.lit(2 * h) <= c("m"), c(f"p{2 * h}") + c(f"p{2 * h + 1}")).otherwise(0.0) for h in range(cut)), F.lit(0.0))
    whole = (c("m") * c("squares") + c("mean") + F.when(c("m") % 2 == 0, c("top")).otherwise(0.0)) / 2  # one side of the spectrum
    ratio = F.when(whole - low > NOTHING * whole, low / (whole - low)).otherwise(0.0)
    return found.select(c("key").alias(key), c("window").cast("int").alias("window"), ratio.alias("ratio"))


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The transforms of the series in the column ``z`` (structs of re and im, in order)."""
    for batch in batches:
        z = batch.column("z")
        starts = z.offsets.to_numpy()
        re, im = (z.values.field(k).to_numpy(zero_copy_only=False) for k in ("re", "im"))
        out = [np.fft.fft(re[a:b] + 1j * im[a:b]) for a, b in zip(starts, starts[1:])]
        flat = np.concatenate([np.zeros(0, complex), *out])
        pairs = pa.StructArray.from_arrays([pa.array(flat.real.copy()), pa.array(flat.imag.copy())], ["re", "im"])
        made = pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), pairs)
        yield pa.RecordBatch.from_arrays([made if n == "z" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)


def transform(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, k, n, re, im): the Fourier transform of each real series of n values.

    A series of n = a * b values, a the greatest divisor of n up to its root, is transformed in two steps: b interleaved
    series of a values each, then, turned by their place, a series of b values each. No task holds more than b values of a
    series; only lengths without divisors (primes) have b = n.
    """
    c = F.col
    lengths = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt("n")).cast("long")), lambda d: c("n") % d == 0))
    own = _placed(df, key, order, value)
    split = own.select("n").distinct().select(c("n").alias("__n"), lengths.alias("a")).withColumn("b", (c("__n") / c("a")).cast("long"))  # a row per length
    dealt = own.join(split, c("n") == c("__n")).select("key", "n", "a", "b", (c("i") % c("b")).alias("r"), F.floor(c("i") / c("b")).alias("j"), "v")
    gathered = lambda frame, keys, place: frame.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place, "re", "im"))).alias("z")).withColumn("z", F.transform("z", lambda e: F.struct(e["re"].alias("re"), e["im"].alias("im"))))
    kind = df.schema[key].dataType.simpleString()
    shape = f"key {kind}, n long, a long, b long, {{}} long, z array<struct<re: double, im: double>>"
    rows = gathered(dealt.withColumns({"re": c("v"), "im": F.lit(0.0)}), ["key", "n", "a", "b", "r"], "j").mapInArrow(_transformed, shape.format("r"))
    first = rows.select("key", "n", "a", "b", "r", F.posexplode("z").alias("k1", "e"))
    turn = -2 * math.pi * (c("r") * c("k1")) / c("n")
    turned = first.select("key", "n", "a", "b", "r", c("k1").cast("long").alias("k1"), (c("e.re") * F.cos(turn) - c("e.im") * F.sin(turn)).alias("re"), (c("e.re") * F.sin(turn) + c("e.im") * F.cos(turn)).alias("im"))
    columns = gathered(turned, ["key", "n", "a", "b", "k1"], "r").mapInArrow(_transformed, shape.format("k1"))
    return columns.select("key", "n", "a", "k1", F.posexplode("z").alias("k2", "e")).select(c("key").alias(key), (c("k1") + c("a") * c("k2")).alias("k"), "n", c("e.re").alias("re"), c("e.im").alias("im"))


def magnitudes(df: DataFrame, key: str, order: str, value: str, inverse: bool = False) -> DataFrame:
    """(key, k, magnitude) of the Fourier transform of each real series: as many as it has values with ``inverse`` (which
    is not divided by their number, and so of the same magnitudes), the lower half without."""
    found = transform(df, key, order, value)
    kept = found if inverse else found.where(F.col("k") <= F.floor(F.col("n") / 2))
    return kept.select(key, F.col("k").cast("int").alias("k"), F.hypot("re", "im").alias("magnitude"))
