"""Distributed prefix sums: order globally, total each partition, add the totals before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned, shuffle_width

#: monotonically_increasing_id keeps a row's place in its partition in its low 33 bits.
_PLACE = (1 << 33) - 1


def in_global_order(df: DataFrame, *order: Column) -> DataFrame:
    """Range-partition and sort ``df``; add ``_part`` and ``_place`` (row within the part).

    The scan position breaks ties, so a key that holds a third of all rows is cut over
    several parts. The result is checkpointed: parts stay the same in every later job.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, F.col("_tie").asc()]
    placed = (
        tied.repartitionByRange(shuffle_width(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
        .withColumns(
            {
                "_part": F.spark_partition_id(),
                "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)),
            }
        )
    )
    # The ids above are those of the sorted parts and stay so; only files get fewer: each task
    # writes several whole parts of these narrow rows into one checkpoint file.
    return pinned(placed, narrow=True)


def totals_before(placed: DataFrame, within: list[str], **sums: Column) -> DataFrame:
    """One row per (within, part): each sum over the parts before it, and over all.

    At most parts + groups rows have to be ordered here, whatever the input holds, since a
    group's rows lie next to each other in the global order.
    """
    per_part = placed.groupBy(*within, "_part").agg(*[c.alias(name) for name, c in sums.items()])
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        *within,
        "_part",
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"{name}_before") for name in sums],
        *[F.sum(name).over(Window.partitionBy(*within)).alias(f"{name}_all") for name in sums],
    )
