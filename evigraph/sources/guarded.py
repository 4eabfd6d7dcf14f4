"""Guarded writes: a new version of a table appears whole, or not at all if any task fails or any row is in conflict."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import compute, fs
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from evigraph.sources.paged import file_system

GUARD = "_conflict"
SHOWN = 5


class WriteConflict(ValueError):
    """Rows are in conflict, or another writer was first; nothing is written."""


@dataclass
class Written(WriterCommitMessage):
    """What one task leaves in the staging folder."""

    file: str | None
    rows: int
    conflicts: int
    shown: list[str]


def versions(path: str) -> list[int]:
    """Numbers of the complete versions, rising; a version is complete with its _SUCCESS file."""
    system, root = file_system(path)
    found = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory]
    names = [p for p in found if p.rsplit("/", 1)[-1].startswith("version=")]
    done = system.get_file_info([f"{p}/_SUCCESS" for p in names])
    return sorted(int(p.rsplit("=", 1)[-1]) for p, mark in zip(names, done, strict=True) if mark.type == fs.FileType.File)


class GuardedWriter(DataSourceArrowWriter):
    """Tasks write to a staging folder and report conflicts; the one commit publishes the folder by a rename or refuses it."""

    def __init__(self, path: str, base: int) -> None:
        self.path, self.base = path, base
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, root = file_system(self.path)
        context = TaskContext.get()
        file = f"{root}/{self.staging}/part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet"
        done = Written(None, 0, 0, [])
        sink = None
        try:
            for batch in iterator:
                guard = batch.column(batch.schema.get_field_index(GUARD))
                bad = guard.filter(compute.is_valid(guard))
                done.conflicts += len(bad)
                done.shown += [str(v) for v in bad.slice(0, SHOWN - len(done.shown)).to_pylist()]
                rows = batch.drop_columns([GUARD])
                if sink is None:
                    system.create_dir(f"{root}/{self.staging}", recursive=True)
                    sink, done.file = pq.ParquetWriter(system.open_output_stream(file), rows.schema), file
                sink.write_batch(rows)
                done.rows += rows.num_rows
        finally:
            if sink is not None:
                sink.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        conflicts = sum(m.conflicts for m in messages if m)
        if conflicts:
            shown = [text for m in messages if m for text in m.shown][:SHOWN]
            self.abort(messages)
            raise WriteConflict(f"{conflicts} rows in conflict, nothing is written: {'; '.join(shown)}")
        system, root = file_system(self.path)
        staged, target = f"{root}/{self.staging}", f"{root}/version={self.base + 1}"
        system.create_dir(staged, recursive=True)
        kept = {m.file for m in messages if m and m.file}
        for info in system.get_file_info(fs.FileSelector(staged)):
            if info.path not in kept:  # of an attempt that did not count
                system.delete_file(info.path)
        if versions(self.path)[-1:] != ([self.base] if self.base else []) or system.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise WriteConflict(f"version {self.base + 1} was written by another job, nothing is written")
        system.move(staged, target)
        with system.open_output_stream(f"{target}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class GuardedTable(DataSource):
    """Options: path and base, the version that the rows were derived from."""

    @classmethod
    def name(cls) -> str:
        return "guarded_table"

    def writer(self, schema: StructType, overwrite: bool) -> GuardedWriter:
        if GUARD not in schema.names:
            raise ValueError(f"a guarded write needs the column {GUARD}")
        return GuardedWriter(self.options["path"], int(self.options["base"]))


def publish(rows: DataFrame, path: str, conflict: Column, base: int | None = None) -> int:
    """Write `rows` as the next version of the table at `path` and return its number.

    `conflict` is a reason or null. If any row has a reason, a task fails, or another version than `base` (default: the newest now) is the newest by
    then, an error is raised and the table is as it was. Give the version the rows were read from as `base`, so that no update is lost.
    """
    base = (versions(path) or [0])[-1] if base is None else base
    rows.sparkSession.dataSource.register(GuardedTable)
    rows.withColumn(GUARD, conflict.cast("string")).write.format("guarded_table").mode("append").option("base", base).save(path)
    return base + 1


def current(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The newest version; without one, an empty frame."""
    known = versions(path)
    return spark.read.schema(schema).parquet(f"{path}/version={known[-1]}") if known else spark.createDataFrame([], schema)
