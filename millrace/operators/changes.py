"""Replay of a change log over a table."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(df: DataFrame, changes: Iterable[Mapping], source: str) -> DataFrame:
    """Applies the changes for ``source`` in the order of their ids: rows with all search fields equal get the updates.

    Fields may be mappings or JSON text. Later changes see earlier edits; unknown columns are added as texts, empty
    elsewhere. Deletion is refused. The log is driver-side configuration, so the replay is one projection.
    """
    for c in sorted((c for c in changes if c["filename"] == source), key=lambda c: c["id"]):
        if c.get("operation", "update") != "update":
            raise ValueError(f"change {c['id']}: {c['operation']} is not supported")
        read = lambda v: json.loads(v) if isinstance(v, str) else v
        hit = F.lit(True)
        for k, v in read(c["search_fields"]).items():
            hit &= F.col(k).cast("string") == str(v)
        new = {}
        for k, v in read(c["update_fields"]).items():
            old, kind = (F.col(k), df.schema[k].dataType) if k in df.columns else (F.lit(""), "string")
            new[k] = F.when(F.coalesce(hit, F.lit(False)), F.lit(v).cast(kind)).otherwise(old)
        df = df.withColumns(new)
    return df
