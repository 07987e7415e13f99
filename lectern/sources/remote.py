"""Remote pages as a Spark data source: one partition a window, an injectable fetcher.

The fetcher is named ``module:function`` and takes (query, first, last, cursor); it returns
(list of row dicts, next cursor or None). Transient errors are tried again with growing
pauses; what still fails, and a window with more
pages than ``pages``, is a row of the error column, for a later recovery batch.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import re
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def split_terms(expression: str) -> list[str]:
    """Distinct terms of an OR list (``|``, ``/`` or ``or``)."""
    return list(dict.fromkeys(t.strip().strip('"') for t in re.split(r"\s*[|/]\s*|\s+or\s+", expression or "", flags=re.I) if t.strip().strip('"')))


def build_query(expression: str, categories: list[str] = (), first: str | None = None, last: str | None = None, field: str = "all") -> str:
    """Query text of an API: terms OR-ed, categories OR-ed, a range of dates, all AND-ed."""
    terms = [f'{field}:"{t}"' if " " in t else f"{field}:{t}" for t in split_terms(expression)]
    groups = [" OR ".join(g) for g in (terms, [f"cat:{c}" for c in categories]) if g]
    parts = [f"({g})" for g in groups]
    if first and last:
        parts.append(f"submittedDate:[{first.replace('-', '')}0000 TO {last.replace('-', '')}2359]")
    return " AND ".join(parts)


class Window(InputPartition):
    def __init__(self, first: str, last: str):
        self.first, self.last = first, last


class PageReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.fields, self.options = [f.name for f in schema.fields], options

    def partitions(self) -> list[Window]:
        windows = [w.split(":") for w in self.options.get("windows", ":").split(",")]
        return [Window(a, b) for a, b in windows]

    def read(self, partition: Window) -> Iterator[tuple]:
        module, _, name = self.options["fetcher"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        cursor, seen = None, set()
        for _ in range(int(self.options.get("pages", "200"))):
            rows, cursor = self._fetch(fetch, partition, cursor)
            for row in rows:
                yield tuple(row.get(f) for f in self.fields)
            if cursor is None or cursor in seen:
                return
            seen.add(cursor)
        yield self._error(f"{partition.first}:{partition.last}:incomplete, goes on at {cursor}")

    def _error(self, text: str) -> tuple:
        return tuple(text if f == "error" else None for f in self.fields)

    def _fetch(self, fetch, window: Window, cursor):
        tries = int(self.options.get("tries", "3"))
        for attempt in range(tries):
            try:
                return fetch(self.options.get("query", ""), window.first, window.last, cursor)
            except OSError as e:
                if attempt == tries - 1:
                    return [{"error": f"{window.first}:{window.last}:{e}"}], None
                time.sleep(float(self.options.get("pause", "1")) * 2**attempt)


class PageStream(DataSourceStreamReader):
    """Windows as a stream: a batch reads the windows that end after the last offset, a task each.

    An offset is the end of the last window (a date, as text) and a digest of what is asked for. It counts for the
    same fetcher, query and columns only: another query starts with its first window.
    """

    def __init__(self, schema, options: dict):
        self.pages = PageReader(schema, options)
        asked = [options.get("fetcher", ""), options.get("query", ""), *self.pages.fields]
        self.context = hashlib.sha1(json.dumps(asked).encode()).hexdigest()

    def initialOffset(self) -> dict:  # noqa: N802
        return {"context": self.context, "upto": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"context": self.context, "upto": max((w.last for w in self.pages.partitions()), default="")}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        done = start["upto"] if start.get("context") == end.get("context") else ""
        return [w for w in self.pages.partitions() if done < w.last <= end["upto"]]

    def read(self, partition: Window) -> Iterator[tuple]:
        return self.pages.read(partition)


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``, then ``spark.read.format("paged").schema(...)``, or ``spark.readStream``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options.get("columns", "title string, abstract string, doi string, error string")

    def reader(self, schema) -> DataSourceReader:
        return PageReader(schema, dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PageStream(schema, dict(self.options))
