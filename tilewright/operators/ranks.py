"""Running totals in the order of a value, without a task that sees a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import frozen

C = F.col


def running_totals(counts: DataFrame, by: list[str], value: str, totals: list[str], descending: bool = False) -> DataFrame:
    """``counts``, one row for each ``value`` of each group, with ``before_`` and ``all_`` each total: its sum over rows of the group that come before, and over all of the group.

    Rows are dealt to tasks by ranges of group and value, so a huge group goes to as many tasks as its values fill; each task adds up its own range, and
    of the ranges before it only their sums are needed, one row for each group and range. Null groups are a group, null values come first (last if descending).
    """
    order = F.desc(value) if descending else F.asc(value)
    # written once: ranges are cut by a sample, another run of it could cut elsewhere
    dealt = frozen(counts.repartitionByRange(*by, order).withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*by, "range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumns({f"before_{t}": F.coalesce(F.sum(t).over(inside), F.lit(0)) for t in totals})
    sums = dealt.groupBy(*by, "range").agg(*(F.sum(t).alias(f"s_{t}") for t in totals))
    group = Window.partitionBy(*(by or [F.lit(1)]))
    earlier = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(C(b).alias(f"r_{b}") for b in by), C("range").alias("r"), *(F.coalesce(F.sum(f"s_{t}").over(earlier), F.lit(0)).alias(f"e_{t}") for t in totals), *(F.sum(f"s_{t}").over(group).alias(f"all_{t}") for t in totals))
    same = reduce(lambda a, b: a & C(b).eqNullSafe(C(f"r_{b}")), by, C("range") == C("r"))
    joined = rows.join(sums, same)
    return joined.select(*counts.columns, *((C(f"before_{t}") + C(f"e_{t}")).alias(f"before_{t}") for t in totals), *(f"all_{t}" for t in totals))
