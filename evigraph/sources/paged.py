"""A complete read of a folder of pages in key order, as a data source: parallel, pruned by key, and failing on a repeated key.

Pages are Parquet files whose names sort as their keys do, as a writer leaves them that asks for the rows after the last key it has seen. A task reads
consecutive pages, checks that keys rise inside a page and from a page to the next, and skips pages that a pushed filter rules out by
their footers. The driver lists names only. Register it once: `spark.dataSource.register(PagedFolder)`; filters are pushed where
`spark.sql.python.filterPushdown.enabled` is on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import compute, fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class RepeatedKey(ValueError):
    """A key was read twice, or pages are out of order."""


class Pages(InputPartition):
    """Consecutive pages and those of the next task, of which the first that is not empty must come after them."""

    def __init__(self, files: list[str], following: list[str]) -> None:
        self.files, self.following = files, following


class PagedReader(DataSourceReader):
    def __init__(self, path: str, key: str, schema: StructType, tasks: int) -> None:
        self.path, self.key, self.schema, self.tasks = path, key, schema, tasks
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of the key with a value are applied here; Spark keeps the rest."""
        for one in filters:
            if isinstance(one, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)) and tuple(one.attribute) == (self.key,):
                self.filters.append(one)
            else:
                yield one

    def partitions(self) -> Sequence[InputPartition]:
        system, root = file_system(self.path)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=False)) if f.is_file and f.path.endswith(".parquet"))
        size = max(1, -(-len(files) // self.tasks))
        return [Pages(files[k : k + size], files[k + size : k + 2 * size]) for k in range(0, len(files), size)]

    def _may_hold(self, low, high) -> bool:
        for one in self.filters:
            value = one.value
            if isinstance(one, In):
                if not any(low <= v <= high for v in value):
                    return False
            elif isinstance(one, EqualTo) and not low <= value <= high:
                return False
            elif isinstance(one, (GreaterThan, GreaterThanOrEqual)) and (high < value or (high == value and isinstance(one, GreaterThan))):
                return False
            elif isinstance(one, (LessThan, LessThanOrEqual)) and (low > value or (low == value and isinstance(one, LessThan))):
                return False
        return True

    def _wanted(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(batch.schema.get_field_index(self.key))
        tests = {EqualTo: compute.equal, GreaterThan: compute.greater, GreaterThanOrEqual: compute.greater_equal, LessThan: compute.less, LessThanOrEqual: compute.less_equal}
        for one in self.filters:
            mask = compute.is_in(keys, pa.array(list(one.value), keys.type)) if isinstance(one, In) else tests[type(one)](keys, pa.scalar(one.value, keys.type))
            batch, keys = batch.filter(mask), keys.filter(mask)
        return batch

    def _ends(self, system: fs.FileSystem, file: str) -> tuple | None:
        """Smallest and largest key of a page by its footer; None for an empty page."""
        with system.open_input_file(file) as source:
            footer = pq.ParquetFile(source).metadata
        at = next(k for k in range(footer.num_columns) if footer.schema.column(k).path == self.key)
        parts = [footer.row_group(g).column(at).statistics for g in range(footer.num_row_groups) if footer.row_group(g).num_rows]
        if any(p is None or not p.has_min_max or p.null_count for p in parts):
            raise RepeatedKey(f"{file}: the key {self.key} has nulls or no statistics")
        return (min(p.min for p in parts), max(p.max for p in parts)) if parts else None

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, (system, _) = to_arrow_schema(self.schema), file_system(self.path)
        last = None
        for file in partition.files:
            ends = self._ends(system, file)
            if ends is None:
                continue
            if last is not None and ends[0] <= last:
                raise RepeatedKey(f"{file}: key {ends[0]!r} comes after {last!r}")
            last = ends[1]
            if not self._may_hold(*ends):
                continue
            with system.open_input_file(file) as source:
                before = None
                for batch in pq.ParquetFile(source).iter_batches(columns=[f.name for f in self.schema]):
                    keys = batch.column(batch.schema.get_field_index(self.key))
                    if before is not None:
                        keys = pa.concat_arrays([pa.array([before], keys.type), keys])
                    rising = compute.greater(keys.slice(1), keys.slice(0, len(keys) - 1))
                    if not compute.all(rising, min_count=0).as_py():
                        raise RepeatedKey(f"{file}: key {keys[compute.index(rising, False).as_py() + 1].as_py()!r} repeats or falls")
                    before = keys[len(keys) - 1].as_py()
                    yield from pa.Table.from_batches([self._wanted(batch)]).select(target.names).cast(target).to_batches()
        following = next((ends for file in partition.following if (ends := self._ends(system, file))), None)
        if following is not None and last is not None and following[0] <= last:
            raise RepeatedKey(f"key {following[0]!r} comes after {last!r}, the last of {partition.files[-1]}")


class PagedFolder(DataSource):
    """Options: path, key (default id) and tasks (default 200, at most one for each page). The schema is the caller's; it must hold the key."""

    @classmethod
    def name(cls) -> str:
        return "paged_folder"

    def schema(self) -> str:
        raise ValueError("paged_folder needs a schema")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options["path"], self.options.get("key", "id"), schema, int(self.options.get("tasks", "200")))


def read_pages(spark: SparkSession, path: str, schema: str | StructType, key: str = "id", tasks: int = 200) -> DataFrame:
    """All rows of a folder of pages; the job that reads them fails if a key repeats."""
    spark.dataSource.register(PagedFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged_folder").schema(schema).option("key", key).option("tasks", tasks).load(path)
