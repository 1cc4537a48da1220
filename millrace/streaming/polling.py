"""A polling source with a resumable cursor: ``spark.readStream.format("polling")``.

A feed is a function of a cursor that returns (rows, next cursor); it is named by ``module:function`` so that the
driver and executors find the same one. Each poll is one batch and one offset.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


def _feed(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class PollingDataSource(DataSource):
    """Options: ``feed`` (module:function), ``since`` (first cursor, default 0), ``polls`` (0: without end)."""

    @classmethod
    def name(cls) -> str:
        return "polling"

    def schema(self) -> str:
        return getattr(_feed(self.options["feed"]), "schema")

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["feed"], int(self.options.get("since", "0")), int(self.options.get("polls", "0")))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, feed: str, since: int, polls: int):
        self.feed, self.since, self.polls = feed, since, polls

    def initialOffset(self) -> dict:
        return {"cursor": self.since, "polls": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.polls and start["polls"] >= self.polls:
            return iter([]), start
        rows, cursor = _feed(self.feed)(start["cursor"])
        return iter(rows), {"cursor": cursor, "polls": start["polls"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same poll again, after a failure."""
        return iter([] if start == end else _feed(self.feed)(start["cursor"])[0])

    def commit(self, end: dict) -> None:
        pass
