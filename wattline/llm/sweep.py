"""Running totals over a whole table in one global order, without a task that sees it all.

``ordered`` deals the rows into ranges of the order and remembers each row's
range; ``running`` sums each range, turns the totals (one row a range) into
offsets, and adds them to the sums inside the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fan_out


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with their range number ``_pid``. Kept, since the sampled range bounds differ from run to run."""
    ranges = df.repartitionByRange(fan_out(df.sparkSession), *order)
    return cut(ranges.withColumn("_pid", F.spark_partition_id()))


def running(df: DataFrame, order: list[str], sums: dict[str, Column], latest: dict[str, Column] | None = None) -> DataFrame:
    """Adds for each of ``sums`` its total over all earlier rows, and for each of ``latest`` its last
    non-null value over the rows up to and with this one. ``df`` comes from ``ordered(df, *order)``."""
    latest = latest or {}
    by_range = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_pid").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(n) for n, c in latest.items()],
    )
    offsets = totals.select(
        "_pid",
        *[F.coalesce(F.sum(n).over(by_range), F.lit(0)).alias(f"_from_{n}") for n in sums],
        *[F.last(n, True).over(by_range).alias(f"_from_{n}") for n in latest],
    )
    here = Window.partitionBy("_pid").orderBy(*order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    # one row for each range: as many as there are shuffle partitions
    joined = df.join(F.broadcast(offsets), "_pid")
    added = {n: F.col(f"_from_{n}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()}
    added |= {n: F.coalesce(F.last(c, True).over(upto), F.col(f"_from_{n}")) for n, c in latest.items()}
    return joined.select("*", *[c.alias(n) for n, c in added.items()]).drop(*[f"_from_{n}" for n in added])
