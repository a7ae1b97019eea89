"""Predicates on project records, and the conjunctive filter that combines them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.presets import CAPACITY_FLOOR_MW, RESOLVED_STAGES, ZERO_CARBON
from ..functions.scalars import split_codes


def in_set(col: Column, values: Sequence[str]) -> Column:
    return col.isin(*values)


def status_is(col: Column, value: str) -> Column:
    """Equal without regard to case; not trimmed; null is not equal."""
    return F.coalesce(F.lower(col) == value, F.lit(False))


def status_in(col: Column, values: Sequence[str]) -> Column:
    return F.coalesce(F.trim(col).isin(*values), F.lit(False))


def containing(col: Column, needles: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(col, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(n) for n in needles])


def exclude_containing(df: DataFrame, col: str, needles: Sequence[str]) -> DataFrame:
    return df.where(~containing(F.col(col), needles))


def below_floor(col: Column, floor: float = CAPACITY_FLOOR_MW) -> Column:
    """Known and below; an unknown capacity is not."""
    return F.coalesce(col < floor, F.lit(False))


def capacity_floor(df: DataFrame, col: str = "capacity_value", floor: float = CAPACITY_FLOOR_MW) -> DataFrame:
    return df.where(F.col(col).isNull() | (F.col(col) >= floor))


def any_of(col: Column, values: Sequence[str]) -> Column:
    """An empty list is no filter."""
    return col.isin(*values) if values else F.lit(True)


def state_contains(col: Column, code: str) -> Column:
    """A list of states holds the code (by case); null holds none, and nothing holds ''."""
    return F.array_contains(split_codes(col), code)


def is_zero_carbon(fuel: Column) -> Column:
    return F.coalesce(fuel.isin(*ZERO_CARBON), F.lit(False))


def exclude_aggregates(df: DataFrame, col: str = "is_aggregate_example") -> DataFrame:
    return df.where(~F.col(col))


def tracked_only(df: DataFrame, stage: str = "current_stage") -> DataFrame:
    return df.where(~F.col(stage).isin(*RESOLVED_STAGES))


def reform_only(causes: DataFrame) -> DataFrame:
    return causes.where(~F.coalesce("is_control_group", F.lit(False)))


@dataclass(frozen=True)
class FilterState:
    """What a reader has chosen; all of it must hold. Rows without years or capacity fail their minimum, 0 included."""

    min_years: float | None = None
    fuel_types: tuple[str, ...] = ()
    project_types: tuple[str, ...] = ()
    min_capacity: float | None = None
    stages: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    state: str | None = None

    def has_active(self) -> bool:
        return any(getattr(self, f.name) not in (None, ()) for f in fields(self))


def matches(f: FilterState) -> Column:
    """One predicate over years_waiting, fuel_type, project_type, capacity_value, current_stage, source_key and state."""
    parts = []
    if f.min_years is not None:
        parts.append(F.col("years_waiting") >= f.min_years)
    for name, values in (("fuel_type", f.fuel_types), ("project_type", f.project_types), ("current_stage", f.stages), ("source_key", f.sources)):
        if values:
            parts.append(any_of(F.col(name), values))
    if f.min_capacity is not None:
        parts.append(F.col("capacity_value") >= f.min_capacity)
    if f.state is not None:
        parts.append(state_contains(F.col("state"), f.state))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def disposition(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, else 'keep'; null counts as not holding."""
    out = F.lit("keep")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out
