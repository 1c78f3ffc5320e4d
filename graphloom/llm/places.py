"""The place of every row in its group, without any group in one task.

Rows are sorted by range, so a large group spans several partitions and small ones share one.
Each partition numbers its rows as it streams them, group by group; only the first group of a
partition can have begun before it, so one number per partition carries the count over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from graphloom.llm.common import stage

_PART, _INDEX, _LOCAL, _TIE = "__place_part", "__place_index", "__place_local", "__place_tie"


def begins(batch: pa.RecordBatch, names: Sequence[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Which rows differ from the row before in one of the columns; ``last`` is the row before the first."""
    new = np.zeros(len(batch), bool)
    new[:1] = last is None
    for name in names:
        column = batch.column(name)
        before = pa.concat_arrays([column.slice(0, 1) if last is None else last.column(name), column.slice(0, len(batch) - 1)])
        same = pc.or_(pc.fill_null(pc.equal(column, before), False), pc.and_(column.is_null(), before.is_null()))
        new |= ~same.to_numpy(zero_copy_only=False)
    return new


def _numbered(group: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, start, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            if not len(batch):
                continue
            index = np.arange(at, at + len(batch))
            starts = np.maximum.accumulate(np.where(begins(batch, group, last), index, start))
            at, start, last = at + len(batch), int(starts[-1]), batch.slice(len(batch) - 1)
            more = {_PART: pa.array(np.full(len(batch), part, np.int32)), _INDEX: pa.array(index), _LOCAL: pa.array(index - starts)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])

    return run


def placed(df: DataFrame, group: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """``df`` and in ``into`` (long) the place of each row, from 0, among those of its ``group`` by ``order``.

    Nulls come first, and null groups are groups. Rows that tie trade places; ties may span partitions too.
    The sorted rows are a written table, so places stay the same for every reader. ``df`` is read twice, once to find the
    ranges.
    """
    keys = [*group, *order, _TIE]
    ranged = df.withColumn(_TIE, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_TIE)
    more = [T.StructField(_PART, T.IntegerType()), T.StructField(_INDEX, T.LongType()), T.StructField(_LOCAL, T.LongType())]
    rows = stage(ranged.mapInArrow(_numbered(list(group)), T.StructType([*df.schema.fields, *more])))
    named = F.struct(*group, F.lit(0).alias("_"))
    # One row per partition of the range sort, whatever the size of the data.
    parts = rows.groupBy(_PART).agg(
        F.min_by(named, _INDEX).alias("head"), F.max_by(named, _INDEX).alias("tail"), (F.max_by(_LOCAL, _INDEX) + 1).alias("n"))
    held = parts.withColumn("sum", F.sum("n").over(Window.partitionBy("tail").orderBy(_PART)))
    along = Window.orderBy(_PART)
    held = held.withColumn("begun", F.when(F.lag("tail").over(along).eqNullSafe(F.col("head")), F.lag("sum").over(along)))
    rows = rows.join(F.broadcast(held.select(_PART, F.coalesce("begun", F.lit(0)).alias("begun"))), _PART)
    place = F.col(_LOCAL) + F.when(F.col(_LOCAL) == F.col(_INDEX), F.col("begun")).otherwise(0)
    return rows.select(*[f"`{c}`" for c in df.columns], place.alias(into))
