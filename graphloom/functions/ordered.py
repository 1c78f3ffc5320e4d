"""Order-dependent steps that never put one whole key into one task.

A window over a hot key would sort all its rows in one task. These helpers take
order-preserving ``blocks`` from finest to coarsest: a window runs inside each
block, one summary row per block carries the state over, and the summaries are
themselves scanned block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.session import cut


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    into: str,
    blocks: Sequence[str],
    inclusive: bool = True,
) -> DataFrame:
    """Last non-null ``value`` at (or, if not inclusive, strictly before) each row.

    ``blocks`` names columns such that rows of one key sorted by ``order`` are
    also sorted by each block, and each block lies inside one of the next.
    """
    last = 0 if inclusive else -1
    if not blocks:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumn(into, F.last(value, ignorenulls=True).over(window))
    block, coarser = blocks[0], list(blocks[1:])
    window = (
        Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    )
    inside = df.withColumn(into, F.last(value, ignorenulls=True).over(window))
    # Order columns are never null, so rows without a value must not win max_by.
    summary = df.groupBy(*keys, *blocks).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_state")
    )
    carry = f"_carry{len(blocks)}"
    carried = last_known(summary, keys, block, "_state", carry, coarser, inclusive=False)
    carried = carried.where(F.col(carry).isNotNull()).select(*keys, block, carry)
    return (
        inside.join(carried, [*keys, block], "left")
        .withColumn(into, F.coalesce(into, carry))
        .drop(carry)
    )


def dense_index(
    df: DataFrame, order: Sequence[str], into: str, within: str | None = None
) -> DataFrame:
    """Consecutive numbers from 0 in a total order, optionally restarting per ``within``.

    A range sort, a checkpoint that fixes the rows, one count per partition and
    an offset join; no task sees more than its own range.
    """
    sorted_rows = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    fixed = cut(sorted_rows)
    # One row per partition of the range sort, whatever the data size.
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    numbered = (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(into, F.col("_offset") + F.col("_row"))
        .drop("_part", "_row", "_offset")
    )
    if within is None:
        return numbered
    starts = numbered.groupBy(within).agg(F.min(into).alias("_start"))
    return (
        numbered.join(starts, within).withColumn(into, F.col(into) - F.col("_start")).drop("_start")
    )


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int | None) -> DataFrame:
    """First k rows per key, all for None. Spark limits each group before the shuffle as well."""
    if k is None:
        return df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
