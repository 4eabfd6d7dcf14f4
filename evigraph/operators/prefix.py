"""Ranks, running sums and quantiles over groups too large for one task.

A plain window sorts each group in one task. Here Spark's own range partitioning puts the rows in global order, as many
slices as the session has shuffle partitions; the ordered rows are checkpointed, so that slices and places in them are facts and not
recomputed, and the totals of the slices before are added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from evigraph.session import cut_lineage

PLACE_BITS = 33  # of monotonically_increasing_id: the partition above, the row in it below


def _same(group: Sequence[str], other: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(group, other, strict=True)], F.lit(True))


def _in_order(df: DataFrame, order: Sequence[tuple[str, bool]], group: Sequence[str]) -> DataFrame:
    """Rows in global order with `_slice`, the partition, and `_row`, the place in it."""
    sort = [F.asc(name) for name in group] + [F.asc(name) if ascending else F.desc(name) for name, ascending in order]
    ordered = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    at = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    return at.withColumn("_slice", F.shiftright("_at", PLACE_BITS)).withColumn("_row", F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)).drop("_at")


def _with_offsets(sliced: DataFrame, group: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row the sums over the slices before its own; the totals are a row for each slice a group touches."""
    before = Window.partitionBy(*[f"_g_{name}" for name in group]).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*[F.col(name).alias(f"_g_{name}") for name in group], F.col("_slice").alias("_s")).agg(
        F.min("_row").alias("_first"), *[value.alias(name) for name, value in sums.items()]
    )
    names = [f"_g_{name}" for name in group]
    offsets = totals.select(*names, "_s", "_first", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums])
    if not group:
        offsets = F.broadcast(offsets)  # a row for each shuffle partition
    return sliced.join(offsets, (F.col("_slice") == F.col("_s")) & _same(group, names)).drop(*names, "_s")


def prefix_sums(
    df: DataFrame, order: Sequence[tuple[str, bool]], values: dict[str, Column], group: Sequence[str] = (), exclusive: bool = False,
) -> DataFrame:
    """Running sums of `values` (name -> integer column) in `order` (column, ascending) within `group`.

    The order should end in a unique column; nulls come first, or last where it descends.
    """
    inputs = {name: f"_in_{i}" for i, name in enumerate(values)}
    sliced = _in_order(df.withColumns({inputs[name]: value for name, value in values.items()}), order, group)
    shifted = _with_offsets(sliced, group, {f"{column}_offset": F.sum(column) for column in inputs.values()})
    frame = Window.partitionBy("_slice", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    outputs = [(F.coalesce(F.sum(column).over(frame), F.lit(0)) + F.col(f"{column}_offset")).alias(name) for name, column in inputs.items()]
    return shifted.select(*df.columns, *outputs)


@F.arrow_udf(LongType())
def _place_in_run(keys: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """1 for the first of equal keys that follow each other in a partition, 2 for the second; a run goes on in the next batch."""
    last, n = None, 0
    for batch in keys:
        if not len(batch):
            yield pa.array([], pa.int64())
            continue
        key = batch.to_numpy(zero_copy_only=False)
        at = np.arange(len(key))
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        places = at - np.maximum.accumulate(np.where(begins, at, 0)) + 1
        if last is not None and key[0] == last:
            first = begins[1:].argmax() + 1 if begins[1:].any() else len(key)
            places[:first] += n
        last, n = key[-1], int(places[-1])
        yield pa.array(places, pa.int64())


def positions(df: DataFrame, order: Sequence[tuple[str, bool]], out: str = "position", group: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """1-based row number in `order`, which should end in a unique column; no window sees the rows. `keep` names the columns of the result, all if None.

    A row's place in the run of its group is counted while the sorted slice is stored. Only the group that a slice begins with can have rows in slices
    before, so what is added is a row for each slice at most, and the stored rows do not travel again.
    """
    keep = df.columns if keep is None else list(keep)
    if not group:
        shifted = _with_offsets(_in_order(df, order, group), group, {"_before": F.count(F.lit(1))})
        return shifted.select(*keep, (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias(out))
    sort = [F.asc(name) for name in group] + [F.asc(name) if ascending else F.desc(name) for name, ascending in order]
    ordered = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    key = F.xxhash64(*[part for name in group for part in (F.col(name).isNull(), F.col(name))])
    kept = list(dict.fromkeys([*keep, *group]))
    stored = cut_lineage(ordered.select(*kept, _place_in_run.asNondeterministic()(key).alias("_nth"), F.monotonically_increasing_id().alias("_at")))
    stored = stored.withColumn("_slice", F.shiftright("_at", PLACE_BITS))
    ends = stored.groupBy("_slice").agg(
        F.min_by(F.struct(*group), "_at").alias("_first"), F.max_by(F.struct(*group), "_at").alias("_last"), F.max_by("_nth", "_at").alias("_n")
    )
    before = F.broadcast(ends.select(F.col("_slice").alias("_earlier"), F.col("_last").alias("_same"), "_n"))
    runs = ends.select("_slice", "_first").join(before, F.col("_first").eqNullSafe(F.col("_same")) & (F.col("_earlier") < F.col("_slice")))
    added = runs.groupBy(F.col("_slice").alias("_s"), F.col("_first").alias("_g")).agg(F.sum("_n").alias("_before"))
    shifted = stored.join(F.broadcast(added), (F.col("_slice") == F.col("_s")) & F.struct(*group).eqNullSafe(F.col("_g")), "left")
    return shifted.select(*keep, (F.col("_nth") + F.coalesce("_before", F.lit(0))).alias(out))


def with_previous(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]], columns: Sequence[Column], out: str) -> DataFrame:
    """Adds the given columns of the row before, as a struct; null for the first row of a group.

    Rows are numbered by slices and met by number, so the rows of a hot group are spread over the tasks.
    """
    numbered = positions(df, order, "_pos", group)
    names = [f"_before_{name}" for name in group]
    before = numbered.select(*[F.col(a).alias(b) for a, b in zip(group, names, strict=True)], (F.col("_pos") + 1).alias("_next"), F.struct(*columns).alias(out))
    return numbered.join(before, (F.col("_pos") == F.col("_next")) & _same(group, names), "left").select(*df.columns, out)


def floor_quantile(df: DataFrame, group: Sequence[str], value: str, share: float | None, out: str) -> DataFrame:
    """Element at floor(n/2) (`share` None) or floor((n-1)*share) of the sorted values of each group."""
    return floor_quantiles(df, group, value, {out: share})


def floor_quantiles(df: DataFrame, group: Sequence[str], value: str, shares: dict[str, float | None]) -> DataFrame:
    """Several floor quantiles at once: name -> share, None for the element at floor(n/2); groups without a value are left out.

    Exact selection in two steps. Values are counted before they are shuffled, and range partitioning by (group, value) makes the counts of
    slices a histogram. Only the slice that holds a rank is looked into, so a task sees a slice of a group and never the group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    sliced = _in_order(counts, [(value, True)], group)
    names = [f"_g_{name}" for name in group]
    whole = Window.partitionBy(*names)
    totals = sliced.groupBy(*[F.col(a).alias(b) for a, b in zip(group, names, strict=True)], F.col("_slice").alias("_s")).agg(F.sum("_n").alias("_sum"))
    sized = totals.withColumn("_upto", F.sum("_sum").over(whole.orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sized = sized.withColumn("_all", F.sum("_sum").over(whole))

    def index(share: float | None) -> Column:
        return F.floor(F.col("_all") / 2) if share is None else F.floor((F.col("_all") - 1) * F.lit(share))

    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), index(share).alias("at")) for name, share in shares.items()]))
    wanted = sized.select(*names, "_s", (F.col("_upto") - F.col("_sum")).alias("_before"), "_upto", ranks.alias("_rank"))
    wanted = wanted.where((F.col("_rank.at") >= F.col("_before")) & (F.col("_rank.at") < F.col("_upto")))
    bucket = sliced.join(wanted, (F.col("_slice") == F.col("_s")) & _same(group, names))
    running = Window.partitionBy("_rank.name", *names).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = bucket.withColumn("_end", F.col("_before") + F.sum("_n").over(running))
    hit = reached.where((F.col("_end") > F.col("_rank.at")) & (F.col("_end") - F.col("_n") <= F.col("_rank.at")))
    return hit.groupBy(*group).agg(*[F.max(F.when(F.col("_rank.name") == name, F.col(value))).alias(name) for name in shares])
