"""Order-dependent plan pieces: the greedy fold over sorted rows, and global row numbers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.plans.staging import stage


def greedy_fold(df: DataFrame, keys: list[str], order: list[Column], step: Callable[[], Callable], inputs: list[str], name: str) -> DataFrame:
    """Adds the boolean ``name``: whether a row starts a new run, decided row by row in order within each key.

    ``step()`` makes a function of the ``inputs`` of a row that keeps what it needs of the run so far, and is called
    with None between keys. Rows stream through: a key of any length takes the memory of its state. Built-in windows
    can't express this in linear work, since where a run starts depends on where the last one did.
    """
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    columns = df.columns

    def run(batches):
        decide, last = step(), ()
        for batch in batches:
            flags = []
            for key, row in zip(zip(*[batch.column(columns.index(k)).to_pylist() for k in keys]), zip(*[batch.column(columns.index(c)).to_pylist() for c in inputs])):
                if key != last:
                    decide(None)
                    last = key
                flags.append(decide(row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], [*columns, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return sorted_rows.mapInArrow(run, f"{fields}, {name} boolean")


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... over the whole table in order, without bringing it to one task.

    Rows are range-partitioned and written with their place in their partition; what is added to it are the sizes of
    the partitions before, one number each.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    written = stage(dealt.withColumn("__part", F.shiftright(place, 33)).withColumn("__at", place.bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = {r["__part"]: r["n"] for r in written.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    if not before:
        return written.drop("__part", "__at").withColumn(name, F.lit(None).cast("bigint"))
    offset = F.element_at(F.lit([before.get(p, 0) for p in range(max(before) + 1)]), F.col("__part").cast("int") + 1)
    return written.withColumn(name, offset + F.col("__at") + 1).drop("__part", "__at")


def number_starts(df: DataFrame, order: list[Column], start: str, name: str) -> DataFrame:
    """Adds ``name``: how many rows with ``start`` there are up to each row, in order over the whole table.

    Rows are range-partitioned by the whole order, so runs and keys of any length are spread, and written once with the
    count within their partition; what is added to it are the counts of the partitions before, one number each.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = df.columns

    def count(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            so_far = before + np.cumsum(batch.column(columns.index(start)).to_numpy(zero_copy_only=False).astype(np.int64))
            before = int(so_far[-1]) if len(so_far) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(so_far), part, np.int32)), pa.array(so_far)], [*columns, "__part", "__at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    written = stage(dealt.mapInArrow(count, f"{fields}, __part int, __at bigint"), "numbered")
    found = {r["__part"]: r["n"] for r in written.groupBy("__part").agg(F.max("__at").alias("n")).collect()}
    sizes = [found.get(p, 0) for p in range(max(found, default=0) + 1)]
    offset = F.element_at(F.lit(np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()).cast("array<bigint>"), F.col("__part") + 1)
    return written.withColumn(name, offset + F.col("__at")).drop("__part", "__at")
