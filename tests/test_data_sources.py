"""The paged reader and the guarded writer on folders."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evigraph.operators import diffs
from evigraph.sources import guarded, paged

ROW = "id bigint, label string, at timestamp"


def write_pages(folder, pages):
    folder.mkdir(exist_ok=True)
    for k, ids in enumerate(pages):
        table = pa.table({
            "id": pa.array(ids, pa.int64()), "other": pa.array([1.5] * len(ids)), "label": pa.array([f"l{i}" for i in ids]),
            "at": pa.array([datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)] * len(ids), pa.timestamp("us", "UTC")),
        })
        pq.write_table(table, folder / f"page-{k:04d}.parquet", row_group_size=3)
    return str(folder)


def test_pages_are_read_in_parallel_and_pruned(spark, tmp_path):
    pages = [list(range(10 * k, 10 * k + 8)) for k in range(23)] + [[], [1000]]
    path = write_pages(tmp_path / "p", pages)
    frame = paged.read_pages(spark, path, ROW, tasks=6)
    assert frame.rdd.getNumPartitions() == 5
    assert sorted(r.id for r in frame.collect()) == sorted(i for p in pages for i in p)
    some = frame.where((F.col("id") > 57) & (F.col("id") <= 73) & (F.col("label") != "l60"))
    assert sorted(r.id for r in some.collect()) == [61, 62, 63, 64, 65, 66, 67, 70, 71, 72, 73]
    assert sorted(r.label for r in frame.where(F.col("id").isin(3, 999, 1000)).collect()) == ["l1000", "l3"]
    assert frame.where("id = 5").first().at == datetime.datetime(2024, 1, 1)


def test_pushed_filters_skip_pages(spark, tmp_path):
    path = write_pages(tmp_path / "p", [[1, 2], [3, 4], [5, 6]])
    (tmp_path / "p" / "page-0002.parquet").write_bytes((tmp_path / "p" / "page-0002.parquet").read_bytes())
    reader = paged.PagedReader(path, "id", spark.createDataFrame([], ROW).schema, 3)
    left = list(reader.pushFilters([paged.LessThan(("id",), 3), paged.EqualTo(("label",), "x")]))
    assert len(left) == 1 and len(reader.filters) == 1
    assert [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()] == [2, 0, 0]


@pytest.mark.parametrize("pages", [[[1, 2], [2, 3]], [[1, 1]], [[1, 2, 3, 4, 5, 5]], [[4, 5], [1, 2]], [[1, 2, 3, 3, 4]], [[1, 2], [2], []]])
@pytest.mark.parametrize("tasks", [1, 10])
def test_a_repeated_key_fails_the_read(spark, tmp_path, pages, tasks):
    with pytest.raises(Exception, match="RepeatedKey"):
        paged.read_pages(spark, write_pages(tmp_path / "p", pages), ROW, tasks=tasks).collect()


TABLE = "id string, label string"


def rows_at(spark, path):
    return sorted(tuple(r) for r in guarded.current(spark, path, TABLE).collect())


def test_a_version_appears_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.createDataFrame([(f"a{k}", f"L{k}") for k in range(50)], TABLE).repartition(5)
    none = F.lit(None).cast("string")
    assert rows_at(spark, path) == []
    assert guarded.publish(first, path, none) == 1
    before = rows_at(spark, path)
    assert len(before) == 50
    broken = first.withColumn("label", F.when(F.col("id") == "a37", F.raise_error(F.lit("late"))).otherwise(F.concat("label", F.lit("!"))))
    with pytest.raises(Exception, match="late"):
        guarded.publish(broken, path, none)
    assert rows_at(spark, path) == before and [p.name for p in (tmp_path / "table").iterdir()] == ["version=1"]
    with pytest.raises(Exception, match="2 rows in conflict"):
        guarded.publish(first, path, F.when(F.col("id").isin("a1", "a49"), F.concat(F.lit("taken "), "id")))
    assert rows_at(spark, path) == before and guarded.versions(path) == [1]
    assert guarded.publish(first.where("id <> 'a0'"), path, none) == 2
    assert len(rows_at(spark, path)) == 49
    with pytest.raises(Exception, match="another job"):
        guarded.publish(first, path, none, base=1)
    assert guarded.versions(path) == [1, 2] and guarded.publish(first.limit(0), path, none) == 3 and rows_at(spark, path) == []


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "table")
    guarded.publish(spark.createDataFrame([("a", "A")], TABLE), path, F.lit(None))
    writers = [guarded.GuardedWriter(path, 1) for _ in range(2)]
    done = []
    for writer, label in zip(writers, "xy", strict=True):
        staged = tmp_path / "table" / writer.staging
        staged.mkdir()
        for name in ("part-0", "lost-attempt"):
            pq.write_table(pa.table({"id": ["a"], "label": [label]}), staged / f"{name}.parquet")
        done.append([guarded.Written(f"{staged}/part-0.parquet", 1, 0, []), None])
    writers[1].commit(done[1])
    with pytest.raises(guarded.WriteConflict, match="another job"):
        writers[0].commit(done[0])
    assert rows_at(spark, path) == [("a", "y")] and sorted(p.name for p in (tmp_path / "table").iterdir()) == ["version=1", "version=2"]


def test_insert_missing_only_through_the_guard(spark, tmp_path):
    path = str(tmp_path / "table")
    guarded.publish(spark.createDataFrame([("a", "A"), ("b", "B")], TABLE), path, F.lit(None))

    def insert(rows):
        live = guarded.current(spark, path, TABLE)
        new = spark.createDataFrame(rows, TABLE)
        states = diffs.missing_or_conflict(new, live, "id", "label").withColumnRenamed("id", "_id")
        joined = new.join(states, F.col("id") == F.col("_id")).where("state <> 'current'").select("id", "label", "state")
        both = live.withColumn("state", F.lit("current")).unionByName(joined)
        return guarded.publish(both.select("id", "label", "state"), path, F.when(F.col("state") == "conflict", F.col("id")))

    insert([("c", "C"), ("a", "A")])
    assert [r.id for r in guarded.current(spark, path, TABLE).orderBy("id").collect()] == ["a", "b", "c"]
    with pytest.raises(Exception, match="1 rows in conflict, nothing is written: e"):
        insert([("d", "D"), ("e", "a")])
    assert [r.id for r in guarded.current(spark, path, TABLE).orderBy("id").collect()] == ["a", "b", "c"]
