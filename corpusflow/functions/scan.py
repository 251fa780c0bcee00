"""Running values over long ordered groups, as a prefix scan over ranks.

A window over one key runs in one task. Here the rows are range-partitioned by group and order, so that segments hold about
equally many rows however sparse or crowded the order is, and a group that holds a third of all rows lies in many of them.
Windows run inside (segment, group); one summary row per segment and group is scanned for what a segment starts with.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.session import cut_lineage

#: Rows of a segment, about.
SEGMENT = 1 << 16


def segmented(df: DataFrame, partition: list[str], order: list[str], segment: int = SEGMENT) -> DataFrame:
    """Add ``_seg``, ascending with the order inside a group.

    The rows are stored once, as they are read by the count, the summaries and the windows, and in segments once more, so
    that a row's segment stays what it is.
    """
    df = cut_lineage(df)
    parts = math.ceil(df.count() / segment)
    if parts <= 1:
        return df.withColumn("_seg", F.lit(0))
    return cut_lineage(df.repartitionByRange(parts, *partition, *order).withColumn("_seg", F.spark_partition_id()))


def _columns(order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else order


def _joined(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    condition = [df[k].eqNullSafe(carry[k]) for k in keys]
    return df.join(carry, condition, "left").drop(*[carry[k] for k in keys])


def _before(partition: list[str]):
    return Window.partitionBy(*partition).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)


def running_last(df: DataFrame, partition: list[str], order: str | list[str], values: dict[str, str],
                 inclusive: bool = True, segment: int = SEGMENT) -> DataFrame:
    """Add, per ``out: column`` of ``values``, the last non-null value up to (or before) each row.

    ``order`` is one or more columns, unique inside a group.
    """
    order = _columns(order)
    keys = [*partition, "_seg"]
    cut = segmented(df, partition, order, segment)
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def at(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.struct(*order))

    summary = cut.groupBy(*keys).agg(*[F.max_by(F.struct(F.col(col).alias("v")), at(col)).alias(f"_s_{out}") for out, col in values.items()])
    carry = summary.select(*keys, *[F.last(f"_s_{out}", ignorenulls=True).over(_before(partition)).alias(f"_c_{out}") for out in values])
    local = cut.select("*", *[
        F.last(F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("v"))), ignorenulls=True)
        .over(inner).alias(f"_l_{out}") for out, col in values.items()])
    return _joined(local, carry, keys).select(*df.columns, *[F.coalesce(f"_l_{out}", f"_c_{out}")["v"].alias(out) for out in values])


def running_sum(df: DataFrame, partition: list[str], order: str | list[str], value: str, out: str,
                segment: int = SEGMENT) -> DataFrame:
    """Add the running sum of ``value`` (inclusive) in ``order``, one or more columns that are unique inside a group."""
    order = _columns(order)
    keys = [*partition, "_seg"]
    cut = segmented(df, partition, order, segment)
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summary = cut.groupBy(*keys).agg(F.sum(value).alias("_s"))
    carry = summary.select(*keys, F.coalesce(F.sum("_s").over(_before(partition)), F.lit(0)).alias("_c"))
    return _joined(cut.withColumn("_l", F.sum(value).over(inner)), carry, keys).select(*df.columns, (F.col("_l") + F.col("_c")).alias(out))
