"""Running totals and row numbers over data of any size.

A plain window over one group puts the group into one task.  Here the rows are spread by range
over (group, order), each slice is summed on its own, and a slice starts from the total of the
slices before it.  A range boundary cuts at most one group, so at most one offset row per slice
is left after the zero offsets are dropped: the broadcast offsets are bounded by the number of
partitions, whatever the data size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqimpact.session import durable

SLICE = "_slice"


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    inclusive: bool = False,
) -> DataFrame:
    """Add, for each entry of `totals`, the sum over the rows before this one in its group.

    `order` should name enough columns to fix the order; rows that tie on all of them are
    interchangeable.  With `inclusive` the row itself is counted too.
    """
    step = {name: f"_step_{name}" for name in totals}
    spread = df.select("*", *[value.alias(step[name]) for name, value in totals.items()])
    spread = spread.repartitionByRange(*by, *order).withColumn(SLICE, F.spark_partition_id())
    # The slice number must be stored: range bounds come from sampling and differ between runs.
    spread = durable(spread)

    before = Window.unboundedPreceding, (0 if inclusive else -1)
    within = Window.partitionBy(SLICE, *by).orderBy(*order).rowsBetween(*before)
    local = spread.select(
        "*", *[F.coalesce(F.sum(step[name]).over(within), F.lit(0)).alias(name) for name in totals]
    )

    per_slice = spread.groupBy(*by, SLICE).agg(*[F.sum(step[name]).alias(step[name]) for name in totals])
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(name).alias(f"_by_{name}") for name in by],
        F.col(SLICE).alias("_by_slice"),
        *[F.sum(step[name]).over(earlier).alias(f"_from_{name}") for name in totals],
        F.count(F.lit(1)).over(earlier).alias("_earlier"),
    ).filter("_earlier > 0")

    same = reduce(
        lambda a, b: a & b,
        [F.col(name).eqNullSafe(F.col(f"_by_{name}")) for name in by],
        F.col(SLICE) == F.col("_by_slice"),
    )
    joined = local.join(F.broadcast(offsets), same, "left")
    return joined.select(
        *df.columns,
        *[(F.col(name) + F.coalesce(F.col(f"_from_{name}"), F.lit(0))).alias(name) for name in totals],
    )


def ordered_domain(df: DataFrame, column: str, index: str = "idx") -> DataFrame:
    """Distinct non-null values of a column with their 0-based place in sorted order."""
    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    return running_totals(values, [], ["value"], {index: F.lit(1).cast("bigint")})
