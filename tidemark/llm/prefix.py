"""Running sums over a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import saved


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``new: value`` of ``sums``, the sum of ``value`` over the rows before in the group.

    The rows are dealt out by range of (group, order), so a group with very many rows spreads over many partitions.
    Each partition's total for each group it holds gives the offsets; these are few rows, a partition and group each.
    """
    at = "__at"
    ranged = saved(df.repartitionByRange(*group, *order).withColumn(at, F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*group, at).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in sums.items()])
    before = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, at, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy(*group, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__s_{n}") for n, v in sums.items()])
    out = out.join(offsets, [*group, at])
    return out.select(*df.columns, *[(F.col(f"__s_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums])
