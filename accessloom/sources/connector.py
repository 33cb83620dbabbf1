"""Collecting from a connector, page by page, as a Python data source (R-21, R-160, R-164, R-166).

A connector is any object with list(kind, parent, token) -> (rows, next token); each partition of the source reads one (kind, parent).
A feed is any object with events(cursor) -> (rows, next cursor, more).
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..schemas import DDL


def loaded(name: str):
    """module:attribute, imported where it is used."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def retried(call, tries: int = 5, wait: float = 0.1):
    """R-166: again after a doubling wait, while tries are left."""
    for n in range(tries):
        try:
            return call()
        except (TimeoutError, ConnectionError):
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)


def too_many_warnings(warnings: int, actions: int) -> bool:
    """R-166: a collection is given up with over ten warnings that are over a tenth of its actions."""
    return warnings > 10 and warnings * 10 > actions


class Scope(InputPartition):
    def __init__(self, kind: str, parent: str):
        self.kind, self.parent = kind, parent


class ConnectorReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self) -> list[Scope]:
        parents = [p for p in self.options.get("parents", "").split(",") if p] or [""]
        return [Scope(self.options["table"], p) for p in dict.fromkeys(parents)]

    def read(self, partition: Scope) -> Iterator[tuple]:
        connector, token, seen = loaded(self.options["connector"]), "", set()
        while True:
            rows, token = retried(lambda token=token: connector.list(partition.kind, partition.parent, token))
            for row in rows:
                yield tuple(row.get(c) for c in self.columns)
            if not token:
                return
            if token in seen:
                raise ValueError(f"page token {token} came twice")
            seen.add(token)


class ConnectorSource(DataSource):
    """spark.read.format("access_connector").option("connector", "module:factory").option("table", "grants")"""

    @classmethod
    def name(cls) -> str:
        return "access_connector"

    def schema(self) -> str:
        return DDL[self.options["table"]]

    def reader(self, schema) -> ConnectorReader:
        return ConnectorReader(dict(self.options), [f.name for f in schema])


class FeedReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def initialOffset(self) -> dict:
        return {"cursor": self.options.get("cursor", "")}

    def pull(self, start: str, stop: str | None) -> tuple[list[tuple], str]:
        feed, cursor, out = loaded(self.options["feed"]), start, []
        for _ in range(int(self.options.get("pages", "10"))):
            if stop is not None and cursor == stop:
                break
            rows, nxt, more = retried(lambda cursor=cursor: feed.events(cursor))
            out += [tuple(r.get(c) for c in self.columns) for r in rows]
            cursor = nxt or cursor
            if not more:
                break
        return out, cursor

    def read(self, start: dict):
        rows, cursor = self.pull(start["cursor"], None)
        return iter(rows), {"cursor": cursor}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.pull(start["cursor"], end["cursor"])[0])


class FeedSource(DataSource):
    """spark.readStream.format("access_feed").option("feed", "module:factory")"""

    @classmethod
    def name(cls) -> str:
        return "access_feed"

    def schema(self) -> str:
        return DDL["events"]

    def simpleStreamReader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options), [f.name for f in schema])


def register(spark) -> None:
    for source in (ConnectorSource, FeedSource):
        spark.dataSource.register(source)
