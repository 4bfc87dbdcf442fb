"""A paged REST scan as a Python data source: one partition per range of offsets (SRC-9, SRC-10).

The fetch function takes (offset, length) and returns a page: num_rows_total, partial and rows. It is passed by name
(`module:function`), so the source works on any executor. Partial pages, a changed total and short pages are errors.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def page_key(url: str) -> str:
    """Cache key of a page (SRC-9)."""
    return hashlib.sha256(url.encode()).hexdigest()


def fetched(fetch: Callable[[int, int], dict], offset: int, length: int, tries: int = 8, pause: float = 0.0) -> dict:
    """A page, after up to `tries` attempts."""
    for k in range(tries):
        try:
            return fetch(offset, length)
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)
    raise AssertionError


class Range(InputPartition):
    def __init__(self, offset: int, length: int, total: int):
        self.offset, self.length, self.total = offset, length, total


class PagedSource(DataSource):
    """Options: fetch (`module:function`), page (rows a page), limit (rows in all, 0: every one)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "position long, json string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.named, self.page, self.limit = options["fetch"], int(options.get("page", 100)), int(options.get("limit", 0))

    def fetch(self) -> Callable[[int, int], dict]:
        module, _, name = self.named.partition(":")
        return getattr(importlib.import_module(module), name)

    def partitions(self) -> list[Range]:
        total = int(fetched(self.fetch(), 0, 1)["num_rows_total"])
        wanted = min(total, self.limit) if self.limit else total
        return [Range(o, min(self.page, wanted - o), total) for o in range(0, wanted, self.page)] or [Range(0, 0, total)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.length:
            return
        page = fetched(self.fetch(), partition.offset, partition.length)
        if page.get("partial"):
            raise ValueError(f"the page at {partition.offset} is partial")
        if int(page["num_rows_total"]) != partition.total:
            raise ValueError(f"the total changed from {partition.total} to {page['num_rows_total']}")
        if len(page["rows"]) < partition.length:
            raise ValueError(f"the page at {partition.offset} has {len(page['rows'])} of {partition.length} rows")
        for k, r in enumerate(page["rows"]):
            yield partition.offset + k, json.dumps(r["row"], ensure_ascii=False, sort_keys=True)
