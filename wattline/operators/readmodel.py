"""The read model: derived columns, nested children, statistics, order, pages, points."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import first_match
from ..functions.presets import COST_PER_KW, SOURCE_LABEL_KEY
from ..functions.scalars import days_waiting, format_capacity, investment_waiting, iso_ms, marker_radius, multi_state_centroid, plain_number, split_codes, waiting_label
from .filters import FilterState, is_zero_carbon, matches
from .lookups import label_lookup, nest_children

SUMMARY = ["slug", "name", "project_type", "fuel_type", "state", "capacity_value", "capacity_unit", "current_stage", "cause_slugs", "years_waiting", "verification_status"]


def derive(projects: DataFrame, as_of: Column) -> DataFrame:
    """Adds days_waiting, years_waiting and investment_waiting."""
    rows = projects.withColumn("days_waiting", days_waiting(F.col("application_filed_date"), as_of))
    return rows.withColumns(
        {
            "years_waiting": F.col("days_waiting") / 365.25,
            "investment_waiting": investment_waiting(F.col("fuel_type"), F.col("capacity_value"), F.col("capacity_unit"), COST_PER_KW),
        }
    )


def source_key(sources: Column) -> Column:
    """From the first source's label; 'other' without one."""
    return first_match(F.try_element_at(sources, F.lit(1))["label"], SOURCE_LABEL_KEY, "other")


def serialize_projects(projects: DataFrame, causes: DataFrame, sources: DataFrame, milestones: DataFrame, as_of: Column) -> DataFrame:
    """Projects with their children nested, and what is derived. Filter ``projects`` first where the filter needs no child."""
    rows = nest_children(projects, causes, "id", "project_id", "_causes", ["cause_slug"], ["cause_slug"])
    rows = rows.withColumn("cause_slugs", F.transform("_causes", lambda c: c["cause_slug"])).drop("_causes")
    rows = nest_children(rows, sources, "id", "project_id", "sources", ["ordinal"], ["label", "url"])
    rows = nest_children(rows, milestones, "id", "project_id", "milestones", ["date", "stage", "description"], ["date", "date_confidence", "stage", "description"])
    return derive(rows, as_of).withColumn("source_key", source_key(F.col("sources")))


def get_project(dto: DataFrame, slug: str) -> DataFrame:
    return dto.where(F.col("slug") == slug).limit(1)


def slim_scan(projects: DataFrame, columns: tuple[str, ...] = ("slug", "updated_at")) -> DataFrame:
    return projects.select(*columns)


def to_summary(dto: DataFrame) -> DataFrame:
    return dto.select(*SUMMARY)


def csv_projection(dto: DataFrame, source_labels: DataFrame) -> DataFrame:
    """Twelve flat text columns; null is empty, whole numbers have no fraction."""
    rows = label_lookup(dto, source_labels, "source_key", "value", "label", "data_source", F.lit("Other"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return rows.select(
        "name", "project_type", "fuel_type", text(F.col("state")).alias("state"), text(F.col("county")).alias("county"),
        text(plain_number(F.col("capacity_value"))).alias("capacity_value"), text(F.col("capacity_unit")).alias("capacity_unit"),
        text(F.col("days_waiting")).alias("days_waiting"), "current_stage", F.array_join("cause_slugs", "|").alias("cause_slugs"),
        "verification_status", "data_source",
    )


def json_projection(dto: DataFrame) -> DataFrame:
    """Dates as ISO-8601 with milliseconds, at both levels."""
    return dto.withColumns(
        {
            "application_filed_date": iso_ms(F.col("application_filed_date").cast("timestamp")),
            "milestones": F.transform("milestones", lambda m: m.withField("date", iso_ms(m["date"].cast("timestamp")))),
        }
    )


def detail_view(dto: DataFrame, stages: DataFrame) -> DataFrame:
    fallback = F.replace(F.col("current_stage"), F.lit("_"), F.lit(" "))
    rows = label_lookup(dto, stages, "current_stage", "value", "label", "stage_label", fallback)
    return rows.select(
        "slug", F.concat_ws(", ", "county", "state").alias("location"), "stage_label",
        format_capacity(F.col("capacity_value"), F.col("capacity_unit")).alias("capacity"), waiting_label(F.col("years_waiting")).alias("waiting"),
        F.when(F.col("investment_waiting.cost_per_kw").isNotNull(), F.format_string("$%,.0f/kW", F.col("investment_waiting.cost_per_kw"))).alias("cost"),
        F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.format_string("%.4f, %.4f", "lat", "lon")).alias("coordinates"),
    )


def aggregate_stats(dto: DataFrame) -> DataFrame:
    """Six numbers in one row and one pass; sums over nothing are 0. Aggregate examples are left out."""
    megawatts = F.when(F.col("capacity_unit") == "MW", F.col("capacity_value"))
    invest = F.when(F.col("investment_waiting.applicable"), F.col("investment_waiting.estimated_usd"))
    clean = F.when(is_zero_carbon(F.col("fuel_type")), megawatts)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return dto.where(~F.col("is_aggregate_example")).agg(
        F.count("*").alias("total_projects"),
        total(megawatts).alias("total_capacity_mw"),
        total(invest).alias("total_investment"),
        F.count(invest).alias("investment_count"),
        total(clean).alias("clean_mw"),
        F.count(clean).alias("clean_count"),
    )


def filtered_stats(dto: DataFrame, f: FilterState) -> DataFrame:
    return aggregate_stats(dto.where(matches(f)))


def facet_states(dto: DataFrame, names: DataFrame) -> DataFrame:
    """Codes that occur in lists of states, with their names, by name."""
    codes = dto.select(F.explode(split_codes(F.col("state"))).alias("code")).distinct()
    return label_lookup(codes, names, "code", "value", "label", "name").orderBy(F.collate("name", "UNICODE"), "code")


def total_matches(dto: DataFrame, f: FilterState) -> DataFrame:
    return dto.where(matches(f)).agg(F.count("*").alias("total_matches"))


def example_project(dto: DataFrame) -> DataFrame:
    """The oldest project with an estimate, else the oldest; aggregate examples never."""
    applicable = F.col("investment_waiting.applicable")
    return dto.where(~F.col("is_aggregate_example")).orderBy((~applicable).asc(), "created_at", "id").limit(1)


def default_order(df: DataFrame) -> DataFrame:
    return df.orderBy("created_at", "id")


def sort_columns(key: str, descending: bool) -> list[Column]:
    """Six keys. Missing numbers count as -1, a missing state as ''; texts sort as readers expect; ties in input order."""
    text = {"name": F.col("name"), "fuel": F.col("fuel_label"), "state": F.coalesce("state", F.lit("")), "stage": F.col("stage_label")}
    number = {"daysWaiting": F.col("days_waiting"), "capacity": F.col("capacity_value")}
    col = F.collate(text[key], "UNICODE") if key in text else F.coalesce(number[key], F.lit(-1))
    return [col.desc() if descending else col.asc(), F.col("created_at").asc(), F.col("id").asc()]


def sort_projects(dto: DataFrame, key: str = "daysWaiting", descending: bool = True) -> DataFrame:
    return dto.orderBy(*sort_columns(key, descending))


def page(ordered: DataFrame, offset: int, limit: int) -> DataFrame:
    return ordered.offset(offset).limit(limit)


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the sort value, the creation time and the id of its last row."""

    value: object
    created_at: datetime
    id: object


def _sort_value(key: str) -> tuple[Column, bool]:
    """What an order sorts by, and whether it is text."""
    text = {"name": F.col("name"), "fuel": F.col("fuel_label"), "state": F.coalesce("state", F.lit("")), "stage": F.col("stage_label")}
    number = {"daysWaiting": F.col("days_waiting"), "capacity": F.col("capacity_value")}
    return (text[key], True) if key in text else (F.coalesce(number[key], F.lit(-1)), False)


def after(key: str, descending: bool, at: Cursor) -> Column:
    """Rows that an order (of ``sort_columns``) puts after a row; ids and creation times are never null.

    For capacities the bound is also given in the column itself, which a scan can use to skip rows."""
    value, is_text = _sort_value(key)
    value = F.collate(value, "UNICODE") if is_text else value
    later = (F.col("created_at") > F.lit(at.created_at)) | ((F.col("created_at") == F.lit(at.created_at)) & (F.col("id") > F.lit(at.id)))
    if at.value is None:  # nulls are first in ascending order and last in descending order
        return value.isNull() & later if descending else value.isNotNull() | later
    bound = F.collate(F.lit(at.value), "UNICODE") if is_text else F.lit(at.value)
    beyond = (value < bound) | value.isNull() if descending else value > bound
    out = beyond | ((value == bound) & later)
    if key == "capacity":
        column = F.col("capacity_value")
        if descending:
            out = ((column <= bound) | column.isNull()) & out
        elif at.value > -1:
            out = (column >= bound) & out
    return out


def page_after(dto: DataFrame, key: str, descending: bool, at: Cursor | None, limit: int) -> DataFrame:
    """The first rows of an order, or those after a cursor: no page costs more than the first one. A row that is added or
    removed before the cursor moves no other row from page to page."""
    return sort_projects(dto if at is None else dto.where(after(key, descending, at)), key, descending).limit(limit)


def cursor_of(page: DataFrame, key: str, descending: bool) -> Cursor | None:
    """Where a page ends; None where it is empty."""
    value, _ = _sort_value(key)
    rows = sort_projects(page, key, descending).select(value.alias("value"), "created_at", "id").collect()  # as many as the page's limit
    return Cursor(rows[-1]["value"], rows[-1]["created_at"], rows[-1]["id"]) if rows else None


def map_points(dto: DataFrame, centroids: Column) -> DataFrame:
    """lon, lat, approximate and radius of each project that can be placed: at its site, else amid its states."""
    amid = multi_state_centroid(F.col("state"), centroids)
    site = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rows = dto.withColumn("_at", F.when(site, F.array("lon", "lat")).otherwise(amid)).where("_at is not null")
    radius = marker_radius(F.col("capacity_value"), F.col("capacity_unit"))
    return rows.withColumns({"lon": F.col("_at")[0], "lat": F.col("_at")[1], "approximate": ~site, "radius": radius}).drop("_at")
