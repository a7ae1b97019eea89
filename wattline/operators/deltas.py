"""Statistics that are kept up to date by what a run changes, in place of being counted anew."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.presets import COST_PER_KW
from ..functions.scalars import investment_waiting
from .filters import FilterState, any_of, is_zero_carbon

#: What statistics can be filtered by: the domains are fixed and small, so their product bounds the kept rows.
DIMENSIONS = {"fuel_types": "fuel_type", "project_types": "project_type", "stages": "current_stage"}
#: Sums are decimals: a sum to which rows were added and from which they were taken is then the sum of what is left.
SUMS = {"total_capacity_mw": "decimal(38,6)", "total_investment": "decimal(38,6)", "clean_mw": "decimal(38,6)"}
COUNTS = ("total_projects", "investment_count", "clean_count")
CUBE = dict.fromkeys(DIMENSIONS.values(), "string") | dict.fromkeys(COUNTS, "long") | SUMS


def measures(value: Callable[[str], Column]) -> dict[str, Column]:
    """What one project adds to each statistic; ``value`` gives its columns. Nothing for a number that is not there."""
    megawatts = F.when(value("capacity_unit") == "MW", value("capacity_value"))
    invest = investment_waiting(value("fuel_type"), value("capacity_value"), value("capacity_unit"), COST_PER_KW)["estimated_usd"]
    clean = F.when(is_zero_carbon(value("fuel_type")), megawatts)
    there = lambda c: F.when(c.isNotNull(), 1).otherwise(0)
    numbers = {"total_capacity_mw": megawatts, "total_investment": invest, "clean_mw": clean}
    exact = {n: F.coalesce(c.try_cast(SUMS[n]), F.lit(0).cast(SUMS[n])) for n, c in numbers.items()}
    return exact | {"total_projects": F.lit(1), "investment_count": there(invest), "clean_count": there(clean)}


def _summed(df: DataFrame) -> DataFrame:
    rows = df.groupBy(*DIMENSIONS.values()).agg(*[F.sum(c).cast(t).alias(c) for c, t in CUBE.items() if c not in DIMENSIONS.values()])
    return rows.where("total_projects <> 0")


def cube(projects: DataFrame) -> DataFrame:
    """Statistics by the dimensions, counted in full; aggregate examples are left out."""
    value = lambda c: F.col(f"p.{c}")
    rows = projects.select(F.struct("*").alias("p")).where(~value("is_aggregate_example"))
    return _summed(rows.select(*[value(d).alias(d) for d in DIMENSIONS.values()], *[m.alias(n) for n, m in measures(value).items()]))


def delta(changes: DataFrame) -> DataFrame:
    """What changes (rows ``old`` and ``new``, null for none) add to the statistics: new rows count, old ones count back."""
    both = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("p")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("p")))
    rows = changes.select(F.explode(both).alias("c")).where("c.p is not null and not c.p.is_aggregate_example")
    value = lambda c: F.col(f"c.p.{c}")
    signed = [(m * F.col("c.sign")).alias(n) for n, m in measures(value).items()]
    rows = rows.select(*[value(d).alias(d) for d in DIMENSIONS.values()], *signed)
    return rows.groupBy(*DIMENSIONS.values()).agg(*[F.sum(c).cast(t).alias(c) for c, t in CUBE.items() if c not in DIMENSIONS.values()])


def add(kept: DataFrame, change: DataFrame) -> DataFrame:
    """Kept statistics after a change; a combination that no project is left of goes."""
    return _summed(kept.unionByName(change))


def stats(kept: DataFrame, f: FilterState | None = None) -> DataFrame:
    """The six numbers of ``aggregate_stats`` from kept statistics, for filters over the dimensions only."""
    f = f or FilterState()
    if any(x is not None for x in (f.min_years, f.min_capacity, f.state)) or f.sources:
        raise ValueError(f"kept statistics can be filtered by {', '.join(DIMENSIONS.values())} only")
    wanted = reduce(lambda a, b: a & b, [any_of(F.col(d), getattr(f, name)) for name, d in DIMENSIONS.items()])
    total = lambda c, t: F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c)
    columns = ("total_projects", "total_capacity_mw", "total_investment", "investment_count", "clean_mw", "clean_count")
    return kept.where(wanted).agg(*[total(c, "long" if c in COUNTS else "double") for c in columns])
