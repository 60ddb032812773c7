"""The order of rows within groups, found over ranges of all rows, so that no group has to lie in one task.

Rows are sorted by group and order over ranges. A task walks its range once; a group may begin in one range and end in another, so
what a range's first group has gathered in earlier ranges is added afterwards, from one summary row for each range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import Scratch

#: Columns that ``walk`` adds; ``Groups`` fills them.
WALKED = StructType().add("_range", IntegerType()).add("_segment", LongType()).add("place", LongType())


def in_ranges(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` sorted by group and order over ranges; equal rows may lie in different ranges, as their place in the input comes last."""
    keys = [by, *order, "_copy"]
    return rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_copy")


class Groups:
    """One task's walk over its range: which group of the range a row is in and its place among the range's rows of that group, from 0."""

    def __init__(self):
        self.range, self.segment, self.n, self.last = TaskContext.get().partitionId(), -1, 0, None

    def walk(self, by: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Segment and place of each row of the next batch, by its column of groups."""
        m = len(by)
        own = pa.concat_arrays([pa.array([self.last], by.type) if self.segment >= 0 else by.slice(0, 1), by])
        a, b = own.slice(0, m), own.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
        new = ~same
        if self.segment < 0:
            new[0] = True
        start = np.maximum.accumulate(np.where(new, np.arange(m), -1))
        place = np.arange(m) - start + np.where(start < 0, self.n, 0)
        segment = self.segment + np.cumsum(new)
        self.segment, self.n, self.last = int(segment[-1]), int(place[-1]), by[m - 1].as_py()
        return segment, place

    def columns(self, segment: np.ndarray, place: np.ndarray) -> list[pa.Array]:
        return [pa.array(np.full(len(place), self.range), pa.int32()), pa.array(segment, pa.int64()), pa.array(place, pa.int64())]


def summaries(walked: DataFrame, by: str, last: Column | None = None) -> list[Row]:
    """A row for each range in order, ``first, last, segments, n_first, n_last, value``: as many as there were tasks, so they fit the driver.

    ``value`` is that of the column ``last`` in the range's last row.
    """
    at = F.struct("_segment", "place")
    found = walked.groupBy("_range").agg(
        F.min_by(F.struct(by), at).alias("first"),
        F.max_by(F.struct(by), at).alias("last"),
        F.max("_segment").alias("segments"),
        F.count(F.when(F.col("_segment") == 0, 1)).alias("n_first"),
        (F.max_by("place", at) + 1).alias("n_last"),
        F.max_by(F.lit(None) if last is None else last, at).alias("value"),
    )
    return found.orderBy("_range").collect()


def offsets(rows: list[Row]) -> dict[int, int]:
    """How many rows of a range's first group lie in earlier ranges, where there are any."""
    out, group, n = {}, None, 0
    for r in rows:
        before = n if group is not None and r["first"] == group else 0
        if before:
            out[r["_range"]] = before
        group, n = r["last"], r["n_last"] + (before if r["segments"] == 0 else 0)
    return out


def moved(walked: DataFrame, before: dict[int, int]) -> DataFrame:
    """``walked`` with places counted over all ranges."""
    if not before:
        return walked
    table = F.broadcast(walked.sparkSession.createDataFrame([(r, n) for r, n in before.items()], "_range int, _before long"))
    more = F.when(F.col("_segment") == 0, F.coalesce("_before", F.lit(0))).otherwise(0)
    return walked.join(table, "_range", "left").withColumn("place", F.col("place") + more).drop("_before")


def placed(rows: DataFrame, by: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``place``: from 0 within each group ``by`` (null is a group) in the given order, nulls first; written to ``scratch``.

    Rows equal in ``by`` and ``order`` have the order of the input.
    """
    at = rows.columns.index(by)

    def run(batches):
        groups = Groups()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *groups.columns(*groups.walk(batch.column(at)))], names=[*batch.schema.names, *WALKED.names])

    schema = StructType([*rows.schema.fields, *WALKED.fields])
    walked = scratch.write(in_ranges(rows, by, order).mapInArrow(run, schema), narrow=False)
    return moved(walked, offsets(summaries(walked, by))).drop("_range", "_segment")
