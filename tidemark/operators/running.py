"""Running sums over a whole table or hot groups, without one task for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import discard, saved


def cumulative(df: DataFrame, group: list[str], order: str, values: list[str], totals_as: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``cum_<value>``: the sum up to and including the row, in its group, by ``order``; and each group's totals.

    ``df`` is computed once: its rows are written as they come, then dealt out by range of group and order; each partition adds the totals of those before it,
    which are one row a partition and group.
    """
    counts = saved(df, "counts")
    ranged = saved(counts.repartitionByRange(*group, order).withColumn("__at", F.spark_partition_id()), "ranged")
    discard(counts)
    totals = ranged.groupBy(*group, "__at").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    earlier = Window.partitionBy(*group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "__at", *[F.coalesce(F.sum(f"__t_{v}").over(earlier), F.lit(0)).alias(f"__o_{v}") for v in values])
    inside = Window.partitionBy(*group, "__at").orderBy(order)
    summed = ranged.select("*", *[F.sum(v).over(inside).alias(f"__s_{v}") for v in values]).join(offsets, [*group, "__at"])
    whole = totals.groupBy(*group).agg(*[F.sum(f"__t_{v}").alias(n) for v, n in zip(values, totals_as, strict=True)])
    return summed.select(*df.columns, *[(F.col(f"__s_{v}") + F.col(f"__o_{v}")).alias(f"cum_{v}") for v in values]), whole
