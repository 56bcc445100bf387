"""Archived list pages as a Spark data source: a partition per range of pages, page filters pushed down, a stream by page number.

``spark.read.format("paged_listing").load(folder)`` gives a row per entry of pages that lie as ``page=N/*`` files of JSON
({"total": ..., "rows": [...]}), with page, place, total, and the entry's fields as JSON. A stream of it goes on behind the last page
that it read. Pages are read in the tasks, through the file system that the folder's address names.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# Tasks get these classes with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "page long, place int, total long, entry string"
#: Pages in one partition.
RANGE = 50
PAGE = re.compile(r"(?:^|/)page=([0-9]+)$")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if re.match(r"^\w+:", folder) else f"file://{folder}")


def archived(folder: str) -> list[int]:
    """The numbers of the pages that are there, ascending."""
    from pyarrow import fs

    store, path = _store(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(int(m[1]) for f in found if (m := PAGE.search(f.path)))


class Range(InputPartition):
    def __init__(self, pages: list[int]):
        self.pages = pages


def ranges(pages: list[int], size: int) -> list[Range]:
    return [Range(pages[k : k + size]) for k in range(0, len(pages), size)]


def rows_of(folder: str, pages: list[int]) -> Iterator[tuple]:
    from pyarrow import fs

    store, path = _store(folder)
    for page in pages:
        place = 0
        for f in sorted(store.get_file_info(fs.FileSelector(f"{path}/page={page}")), key=lambda f: f.path):
            if f.base_name.startswith(("_", ".")):
                continue
            with store.open_input_stream(f.path) as stream:
                text = stream.readall().decode()
            for line in filter(None, text.splitlines()):
                whole = json.loads(line)
                for entry in whole.get("rows") or ():
                    place += 1
                    yield page, place, whole.get("total"), json.dumps(entry, ensure_ascii=False, sort_keys=True)


class Pages(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size, self.least, self.most = folder, size, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of the page number leave out whole pages; what isn't one stays with Spark."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at != ("page",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                last = f.value - isinstance(f, LessThan)
                self.most = last if self.most is None else min(self.most, last)

    def partitions(self) -> list[Range]:
        return ranges([p for p in archived(self.folder) if p >= self.least and (self.most is None or p <= self.most)], self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows_of(self.folder, partition.pages if partition else [])  # Spark reads nothing as one partition of None


class NewPages(DataSourceStreamReader):
    """The offset is the number of the next page to read."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"page": max(archived(self.folder), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges([p for p in archived(self.folder) if start["page"] <= p < end["page"]], self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows_of(self.folder, partition.pages if partition else [])  # Spark reads nothing as one partition of None


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("pagesPerPartition", RANGE))

    def reader(self, schema) -> Pages:
        return Pages(self.options["path"], self._size())

    def streamReader(self, schema) -> NewPages:  # noqa: N802
        return NewPages(self.options["path"], self._size())


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down to it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(PagedListing)
