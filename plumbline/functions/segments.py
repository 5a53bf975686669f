"""Ordered work over keys of any size.

A plain window sorts one key in one task. These helpers cut each key into
segments, work inside a segment, and carry one summary row per segment across
the cut, so a key holding a third of the rows is still shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 2048


def segment_of(ordinal: Column, size: int = SEGMENT) -> Column:
    return F.floor(ordinal / F.lit(size)).cast("bigint")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column,
    value: Column, out: str,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its key."""
    cut = df.withColumn("_seg", segment).withColumn("_val", value)
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_in", F.coalesce(F.sum("_val").over(before), F.lit(0)))
    totals = cut.groupBy(*keys, "_seg").agg(F.sum("_val").alias("_total"))
    across = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_seg", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_carry")
    )
    return (
        local.join(carry, [*keys, "_seg"])
        .withColumn(out, F.col("_in") + F.col("_carry"))
        .drop("_seg", "_val", "_in", "_carry")
    )


def neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column,
    values: dict[str, Column], after: bool = False,
) -> DataFrame:
    """Add the previous (or next) row's ``values`` under the given names; NULL at the end."""
    packed = F.struct(*[v.alias(k) for k, v in values.items()])
    cut = df.withColumn("_seg", segment).withColumn("_pack", packed)
    rank = F.struct(*[F.col(o) for o in order])
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    step = F.lead("_pack") if after else F.lag("_pack")
    local = cut.withColumn("_near", step.over(inside))
    edge = F.min_by("_pack", rank) if after else F.max_by("_pack", rank)
    ends = cut.groupBy(*keys, "_seg").agg(edge.alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_seg")
    reach = F.lead("_edge") if after else F.lag("_edge")
    carry = ends.select(*keys, "_seg", reach.over(across).alias("_carry"))
    # As large as the rows where keys are short, so it is never sent whole to every task.
    joined = local.join(carry.hint("merge"), [*keys, "_seg"]).withColumn(
        "_near", F.coalesce("_near", "_carry")
    )
    for name in values:
        joined = joined.withColumn(name, F.col(f"_near.{name}"))
    return joined.drop("_seg", "_pack", "_near", "_carry")
