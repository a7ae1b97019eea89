"""From each source's fields to the common record: one select of column expressions each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import presets as P
from ..functions.classify import code_map_with_override, contains_rules, exact_map, first_match
from ..functions.scalars import blank_to_null, clean_cell, note_parts, parse_date_cell, planned_operation, slugify, status_code, to_number
from ..operators.lookups import apply_overrides, geocode_by_code

#: The business columns of a record.
RECORD = {
    "match_key": "string", "slug": "string", "name": "string", "project_type": "string", "fuel_type": "string", "lat": "double", "lon": "double",
    "state": "string", "county": "string", "capacity_value": "double", "capacity_unit": "string", "application_filed_date": "timestamp",
    "date_confidence": "string", "current_status": "string", "current_stage": "string", "cause_detail": "string", "is_aggregate_example": "boolean",
    "estimated_mw_delayed": "double", "data_quality_note": "string", "external_ids": "map<string,string>",
}
CHILDREN = {"cause_slugs": "array<string>", "sources": "array<struct<label:string,url:string>>", "milestones": "array<struct<date:timestamp,date_confidence:string,stage:string,description:string>>"}
SOURCE_LINKS = {
    "eia": ("EIA-860M planned generators", "https://www.eia.gov/electricity/data/eia860m/"),
    "permittingDashboard": ("Federal Permitting Dashboard", "https://www.permits.performance.gov/permitting-project/"),
    "lbnl": ("LBNL Queued Up interconnection requests", "https://emp.lbl.gov/queues"),
    "ornlHydro": ("ORNL HydroSource relicensing", "https://hydrosource.ornl.gov/data/datasets/"),
    "eiaPipelines": ("EIA Natural Gas Pipeline projects", "https://www.eia.gov/naturalgas/data.php"),
}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _record(df: DataFrame, source: str, source_id: Column, overrides: DataFrame | None, url: Column | None = None, **values) -> DataFrame:
    """All columns of a record. ``values``: those that the source has; the rest get their defaults."""
    values = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    label, link = SOURCE_LINKS[source]
    values.setdefault("date_confidence", F.lit("exact"))
    values.setdefault("is_aggregate_example", F.lit(False))
    values["sources"] = F.array(F.struct(F.lit(label).alias("label"), (F.lit(link) if url is None else url).alias("url")))
    values.setdefault("cause_slugs", F.array())
    place = [F.col("_ordinal").alias("ordinal")] if "_ordinal" in df.columns else []
    rows = df.select(F.lit(source).alias("source"), source_id.alias("source_id"), *[v.alias(k) for k, v in values.items()], *place)
    rows = rows.withColumn("external_ids", F.create_map("source", "source_id"))
    rows = rows.withColumn("match_key", F.concat_ws(":", "source", "source_id")) if overrides is None else apply_overrides(rows, overrides)
    rows = rows.withColumn("slug", slugify(F.col("name"), F.col("match_key")))
    have = set(rows.columns)
    columns = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (RECORD | CHILDREN).items()]
    return rows.select("source", "source_id", *columns, *(["ordinal"] if place else []))


def _kind(fuel: Column) -> Column:
    return F.when(fuel == "storage", "storage").otherwise("generation")


def normalize_eia860m(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Rows without a status code are dropped; an unknown code is agency permitting."""
    code = status_code(_text("status"))
    fuel = code_map_with_override(_text("energy_code"), _text("technology"), P.EIA_TECHNOLOGY_FUEL, P.EIA_FUEL, "other")
    generator = F.when(_text("generator_id") != "", _text("generator_id")).otherwise("?")
    capacity = to_number(F.col("capacity"))
    when = planned_operation(_text("op_month"), _text("op_year"))
    return _record(
        df.where(code != ""), "eia", F.concat_ws("-", _text("plant_id"), _text("generator_id")), overrides,
        name=F.concat(F.coalesce("plant_name", F.lit("Unnamed plant")), F.lit(" (Unit "), generator, F.lit(")")),
        project_type=_kind(fuel), fuel_type=fuel, lat=to_number(F.col("lat")), lon=to_number(F.col("lon")),
        state=blank_to_null(F.col("state")), county=blank_to_null(F.col("county")),
        capacity_value=F.when(capacity != 0, capacity), capacity_unit="MW", date_confidence="approximate",
        current_status=_text("status"), current_stage=exact_map(code, P.EIA_STAGE, P.DEFAULT_STAGE),
        cause_detail="From the EIA-860M inventory of planned generators, which does not say what a project waits for.",
        data_quality_note=F.concat(F.lit("The inventory has no filing date, so no waiting time is computed; planned operation: "), when, F.lit(".")),
    )


def normalize_dashboard(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    title, sector = _text("project_title"), F.col("project_sector")
    status = F.coalesce("project_field_project_status", F.lit("Unknown"))
    agencies = F.concat_ws(" / ", blank_to_null(F.col("project_field_project_lead_agency")), blank_to_null(F.col("project_field_project_lead_agency_bureau")))
    fallback = F.concat(F.lit(SOURCE_LINKS["permittingDashboard"][1]), "project_id")
    return _record(
        df, "permittingDashboard", F.col("project_id"), overrides, F.coalesce(F.col("project_url.url"), fallback),
        name=F.col("project_title"), project_type=exact_map(sector, P.SECTOR_TYPE, "generation"),
        fuel_type=first_match(title, P.DASHBOARD_TITLE_FUEL, exact_map(sector, P.SECTOR_FUEL, "other")),
        lat=to_number(F.col("project_lat")), lon=to_number(F.col("project_lon")),
        state=F.col("project_field_location_state"), county=F.col("project_field_location_county"),
        current_status=F.when(agencies != "", F.concat(status, F.lit(" (lead: "), agencies, F.lit(")"))).otherwise(status),
        current_stage=contains_rules(status, P.DASHBOARD_STAGE, P.DEFAULT_STAGE),
        cause_detail="From the Federal Permitting Dashboard, whose open data names neither causes nor filing dates.",
        data_quality_note="The fuel is taken from words of the title and is provisional.",
    )


def normalize_lbnl(df: DataFrame, centroids: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``centroids``: fips5, lat, lon of counties."""
    df = geocode_by_code(df, centroids, "fips")
    resource, phase = _text("resource"), _text("ia_phase")
    fuel = first_match(resource, P.LBNL_RESOURCE_FUEL, "other")
    extra = lambda c, a, b: F.when(c != "", F.concat(F.lit(a), c, F.lit(b))).otherwise("")
    return _record(
        df, "lbnl", F.concat_ws("-", _text("entity"), _text("queue_id")), overrides,
        name=F.concat(_text("entity"), F.lit(" Interconnection Request "), _text("queue_id"), extra(resource, " (", ")")),
        project_type=_kind(fuel), fuel_type=fuel, lat=F.col("lat"), lon=F.col("lon"), state=blank_to_null(F.col("state")), county=blank_to_null(F.col("county")),
        capacity_value=to_number(F.col("capacity")), capacity_unit="MW", application_filed_date=parse_date_cell(F.col("queue_date")),
        current_status=F.concat(F.lit("Interconnection queue status: active"), extra(phase, " (", ")"), extra(_text("region"), ", ", " region")),
        current_stage=contains_rules(phase, P.LBNL_STAGE, "interconnection_study"), cause_slugs=F.array(F.lit("interconnection_queue_backlog")),
        cause_detail="From LBNL's Queued Up data: the project waits for its grid operator's study or agreement.",
        data_quality_note=F.when(F.col("lat").isNotNull(), "Placed at the middle of its county; the site is not published.").otherwise("The county has no known middle, so the project is not placed."),
    )


def normalize_ornl(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Rows in the two waiting statuses only."""
    status, procedure, docket = F.trim(_text("status")), _text("proc_type"), _text("docket")
    applied, noticed = parse_date_cell(F.col("application_date")), parse_date_cell(F.col("noi_date"))
    shown = F.when((procedure != "") & (procedure != "NA"), F.concat(F.lit(" ("), procedure, F.lit(" process)"))).otherwise("")
    return _record(
        df.where(status.isin(*P.ORNL_WAITING)), "ornlHydro", docket, overrides,
        name=F.concat(F.coalesce("project_name", F.lit("Unnamed hydropower project")), F.lit(" (FERC No. "), F.when(docket != "", docket).otherwise("?"), F.lit(")")),
        project_type="generation", fuel_type="hydro", lat=to_number(F.col("lat")), lon=to_number(F.col("lon")), state=blank_to_null(F.col("state")),
        capacity_value=to_number(F.col("capacity")), capacity_unit="MW", application_filed_date=F.coalesce(applied, noticed),
        current_status=F.concat(F.lit("FERC relicensing: "), status, shown), current_stage=P.ORNL_STAGE,
        cause_detail="From ORNL HydroSource's relicensing data, which names no cause.",
        data_quality_note=F.when(applied.isNull() & noticed.isNotNull(), "No application is filed yet; the waiting time starts at the notice of intent."),
    )


def normalize_pipeline(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Rows without a status are dropped; an unknown status is agency permitting."""
    c = {f: clean_cell(F.col(f)) for f in P.HEADERS["eiaPipelines"]}
    name = F.coalesce(c["project_name"], F.lit("Unnamed pipeline project"))
    operator = F.coalesce(c["operator"], F.lit(""))
    kind = F.when(c["pipeline_type"].isNotNull(), F.concat(F.lit(" ("), c["pipeline_type"], F.lit(" pipeline)"))).otherwise("")
    note = note_parts(
        F.concat(F.lit("No filing date is published, only a year in service ("), F.coalesce(c["in_service_year"], F.lit("unknown")), F.lit(").")),
        F.concat(F.lit("Project length: "), c["miles"], F.lit(" miles.")),
        F.concat(F.lit("Estimated cost: $"), c["cost_millions"], F.lit(" million.")),
    )
    return _record(
        df.where(c["status"].isNotNull()), "eiaPipelines", F.coalesce(c["docket"], F.concat_ws("-", operator, name)), overrides,
        name=F.when(operator != "", F.concat(name, F.lit(" ("), operator, F.lit(")"))).otherwise(name),
        project_type="pipeline", fuel_type="pipeline", state=c["states"], capacity_value=to_number(c["capacity"]), capacity_unit="MMcf/d",
        date_confidence="approximate", current_status=F.concat(F.lit("EIA pipeline tracker: "), c["status"], kind),
        current_stage=exact_map(F.lower(c["status"]), P.PIPELINE_STAGE, P.DEFAULT_STAGE),
        cause_detail="From EIA's list of gas pipeline projects, which names no cause.", data_quality_note=note,
    )
