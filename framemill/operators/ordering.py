"""Exact global positions, ranks and running sums without a single-task window.

Rows are range-partitioned and sorted, each keeps its partition and its place in
it, and only one total per partition (and group) meets in a small offsets table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framemill.session import stored

_PLACE = (1 << 33) - 1


def placed(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order`` and sorted, stored, with ``_part`` and ``_place`` (0-based in the partition)."""
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)
    ident = F.monotonically_increasing_id()
    out = ranged.withColumn("_mid", ident).withColumn("_part", F.shiftright("_mid", 33).cast("int"))
    return stored(out.withColumn("_place", F.col("_mid").bitwiseAND(F.lit(_PLACE))).drop("_mid"), name)


def running_sum(df: DataFrame, value: str, order: list[Column], out: str, name: str = "running", partitions: int | None = None) -> DataFrame:
    """Sum of ``value`` over all rows before this one in ``order`` (exclusive), as column ``out``.

    Ties in ``order`` are resolved arbitrarily but once; nulls in ``value`` count as 0; an empty input gives an empty result.
    """
    rows = placed(df, order, name, partitions)
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    v = F.coalesce(F.col(value), F.lit(0))
    totals = rows.groupBy("_part").agg(F.sum(v).alias("_sum"))
    # one row per range partition: the window over them is bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return (
        rows.withColumn(out, F.coalesce(F.sum(v).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col(out) + F.col("_base"))
        .drop("_part", "_place", "_base")
    )
