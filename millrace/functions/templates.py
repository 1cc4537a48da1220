"""Templates of functions a user adds: an aggregate over Arrow batches and a function of rows to tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def aggregate(fn: Callable[[np.ndarray], float], kind: str = "double") -> Callable[..., Column]:
    """An aggregate of one column from a function of a numpy array; nulls are left out, no value gives null.

    A group is held whole in one worker: for groups without a bound, use built-in aggregates, which combine map-side.
    """

    def run(values: pd.Series) -> float:
        known = values.dropna().to_numpy()
        return fn(known) if len(known) else None

    run.__annotations__ = {"values": pd.Series, "return": float}
    return F.pandas_udf(run, kind)


@F.udtf(returnType="place int, part string")
class SplitText:
    """The parts of a text around a separator, numbered from 0; a null gives no row."""

    def eval(self, text: str, separator: str):
        if text is not None:
            yield from enumerate(text.split(separator))
