"""Registered queries over files that are landed first: editions of the sources, overrides, exports read back; and orders of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import presets as P
from .operators import filters as FI
from .operators import lookups as L
from .operators import readmodel as R
from .plans import normalize as N
from .plans.ingest import ingest, normalized
from .plans.snapshots import SnapshotStore
from .queries import as_of, dto, proj, read, rounded, shared_folder
from .sources import dims as D
from .sources import export as X
from .sources import readers as RD


def one_of(values: tuple, key: Column) -> Column:
    """A value for each row, in turn."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def land_sheet(spark: SparkSession, rows: DataFrame, cells: dict[str, Column], source: str, title: str) -> str:
    """Writes a sheet as text: lines of title, the headers in line ``HEADER_ROW``, then the rows in as many files as they come in."""
    folder = shared_folder(spark, source)
    quote = lambda h: '"' + h.replace('"', '""') + '"'
    head = [title] * P.HEADER_ROW[source] + [",".join(map(quote, cells))]
    spark.createDataFrame([(x,) for x in head], "line string").coalesce(1).write.mode("append").text(f"{folder}/part=0")
    lines = rows.select(F.to_csv(F.struct(*[v.alias(f"c{i}") for i, v in enumerate(cells.values())]), {"quoteAll": "true", "escape": '"', "nullValue": ""}).alias("line"))
    lines.write.mode("append").text(f"{folder}/part=1")
    return f"{folder}/part=*"


def ingest_eia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as the planned generators' sheet, under two lines of title, with padded headers and separators of
    thousands; every tenth has an override in a file of overrides."""
    rows, key = proj(spark, sf_dir, states=False), F.col("id")
    cells = {h[0]: F.lit(None).cast("string") for h in P.HEADERS["eia"].values()}
    cells |= {
        "Plant ID": key.cast("string"), "Plant Name": F.concat(F.lit('Plant "A", '), "name"), "Generator ID": F.when(key % 6 != 0, "G1"), "Plant State": F.lit("TX"),
        "Nameplate Capacity (MW)": F.when(key % 3 == 0, F.format_number("capacity_value", 5)).otherwise(F.round("capacity_value", 5).cast("string")),
        "Technology": one_of(("Turbine", "Batteries", "Offshore Wind Turbine", "Battery storage"), key), "Energy Source Code": F.col("energy_code"), "Status": F.when(key % 8 == 0, "no code").otherwise(F.col("status")),
        "Planned Operation Year": F.lit("2030"), "Planned Operation Month": F.when(key % 2 == 0, "6"), "Latitude": F.when(key % 2 == 0, "31.5"), "Longitude": F.when(key % 2 == 0, "-99.25"),
    }
    cells = {(f" {h} " if h in ("Plant ID", "Status") else h): c for h, c in cells.items()}
    path = land_sheet(spark, rows, cells, "eia", "Inventory of planned generators")
    overrides = shared_folder(spark, "overrides")
    number = F.concat_ws("-", key.cast("string"), F.when(key % 6 != 0, "G1").otherwise(""))
    named = rows.where(key % 10 == 0).select(F.lit(" eia").alias("source"), F.concat(number, F.lit(" ")).alias("sourceId"), F.concat(F.lit("site:"), key.cast("string")).alias("matchKey"))
    named.write.option("header", True).csv(overrides)
    out = normalized(spark, "eia", path, overrides).records
    return out.select("source_id", "match_key", "slug", "name", "project_type", "fuel_type", "lat", "lon", "state", "capacity_value", "current_stage", F.substring_index("data_quality_note", ": ", -1).alias("planned"))


def ingest_lbnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as the interconnection queue's sheet; nations give the middles of counties."""
    rows, key = proj(spark, sf_dir, states=False), F.col("id")
    cells = {h[0]: F.lit(None).cast("string") for h in P.HEADERS["lbnl"].values()}
    day = F.col("application_filed_date")
    cells |= {
        "q_id": F.concat(F.lit("Q"), key.cast("string")), "q_status": one_of(("Active", "active", "withdrawn", "ACTIVE"), key), "entity": F.concat(F.lit("Grid "), (key % 4).cast("string")),
        "state": F.lit("NY"), "county": one_of(("Kings", ""), key), "fips_code": F.when(key % 5 != 0, ((key % 30) * 97).cast("string")),
        "type_clean": one_of(("Solar+Battery", "Offshore Wind", "Upwind", "Gas", "Coal", ""), key), "mw_1": F.round("capacity_value", 5).cast("string"),
        "q_date": F.when(key % 3 == 0, F.datediff(day, F.lit("1899-12-30")).cast("string")).when(key % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise("NA"),
        "IA_phase_clean": one_of(("Facility Study", "IA Executed", "", "Construction", "System Impact Study"), key), "region": one_of(("West", "", "Northeast"), key),
    }
    nations = read(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0")
    middles = nations.select(F.lpad((F.col("n_nationkey") * 97).cast("string"), 5, "0").alias("fips5"), (F.col("n_nationkey") + 0.5).alias("lat"), (-F.col("n_nationkey") - 0.25).alias("lon"))
    path = land_sheet(spark, rows, cells, "lbnl", "Queued up")
    out = normalized(spark, "lbnl", path, centroids=middles).records
    return out.select(
        "source_id", "match_key", "slug", "name", "project_type", "fuel_type", "lat", "lon", "county", "capacity_value", "current_status", "current_stage", F.array_join("cause_slugs", "|").alias("causes"),
        F.date_format("application_filed_date", "yyyy-MM-dd").alias("filed"), F.col("data_quality_note").contains("no known middle").alias("unplaced"),
    )


def _pipelines(spark: SparkSession, sf_dir: str) -> str:
    """Lands the orders by id, as of two records with one slug the one that landed last wins."""
    rows, key = proj(spark, sf_dir, states=False), F.col("id")
    cells = {h[0]: F.lit(None).cast("string") for h in P.HEADERS["eiaPipelines"].values()}
    cells |= {
        "Project Name": F.when(key % 9 != 0, F.concat(F.lit("Line "), key.cast("string"))), "Pipeline Operator Name": one_of(("Acme, Inc.", "-", "na", "Bolt"), key),
        "Status": one_of(("Announced", "Approved ", "on hold", "Construction", "NA", "Completed", "unheard of"), key), "Year In Service Date": F.when(key % 5 != 0, "2031"),
        "State(s)": one_of(("NY,CT,MA,RI", "TX, MX", "TX"), key), "Cost (millions)": F.when(key % 2 == 0, (key % 1000).cast("string")), "Miles": F.when(key % 3 == 0, (key % 100).cast("string")).otherwise("-"),
        "Additional Capacity (MMcf/d)": F.when(key % 7 != 0, F.format_number(F.floor(F.col("capacity_value") * 10), 0)).otherwise("-"), "Pipeline Type": one_of(("Interstate", "", "na"), key),
        "Docket/Permit  Number": F.when(key % 4 == 0, F.concat(F.lit("CP-"), key.cast("string"))).otherwise("-"),
    }
    cells.pop("Docket/Permit Number")
    return land_sheet(spark, rows.orderBy("id"), cells, "eiaPipelines", "Natural gas pipeline projects")


def ingest_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as the pipelines' sheet, with blanks, "na" and "-" for what is missing and two spaces in a header."""
    out = normalized(spark, "eiaPipelines", _pipelines(spark, sf_dir)).records
    return out.select("source_id", "match_key", "slug", "name", "project_type", "fuel_type", "state", "capacity_value", "capacity_unit", "current_status", "current_stage", F.col("data_quality_note").alias("note"))


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of the pipelines' ingestion, and how many projects the store holds after it and after a second run of it."""
    store, path = SnapshotStore(spark, shared_folder(spark, "store")), _pipelines(spark, sf_dir)
    out = ingest(store, "eiaPipelines", path, F.lit("2001-01-01").cast("timestamp"))
    ingest(store, "eiaPipelines", path, F.lit("2001-02-01").cast("timestamp"))
    held = store.read()["projects"].agg(F.count("*").alias("stored"), F.count_if(F.col("created_at") < F.col("updated_at")).alias("updated"))
    return out.summary.withColumn("_one", F.lit(1)).join(held.withColumn("_one", F.lit(1)), "_one").drop("_one")


def overrides_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of overrides with padded cells, blank lines and repeated ids, read and applied to all suppliers."""
    key, folder = F.col("s_suppkey"), shared_folder(spark, "overrides")
    lines = read(spark, sf_dir, "supplier").where(key % 5 == 0).select(
        one_of(("supplier", " supplier ", ""), key).alias("source"), F.concat(F.lit(" "), key.cast("string")).alias("sourceId"), F.when(key % 20 != 0, F.concat(F.lit("merged-"), key.cast("string"), F.lit(" "))).alias("matchKey")
    )
    lines.write.option("header", True).csv(folder)
    rows = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), key.cast("string").alias("source_id"))
    return L.apply_overrides(rows, RD.read_overrides(spark, folder)).select("source_id", "match_key")


def exclude_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose priority does not tell of what is cleared already."""
    return FI.exclude_containing(read(spark, sf_dir, "orders"), "o_orderpriority", ["urgent", "low"]).select("o_orderkey", "o_orderpriority")


def source_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of two of several sources, told by the label of the first of their sources."""
    label = one_of(("EIA-860M planned", "LBNL Queued Up", "a list", "ORNL HydroSource", "federal permitting dashboard"), F.col("id"))
    rows = dto(spark, sf_dir, states=False).withColumn("sources", F.when(F.col("id") % 11 != 0, F.array(F.struct(label.alias("label")))))
    rows = rows.withColumn("source_key", R.source_key(F.col("sources")))
    return rows.where(FI.matches(FI.FilterState(sources=("lbnl", "permittingDashboard", "other")))).select("id", "source_key")


def default_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first projects of the default order."""
    return R.page(R.default_order(proj(spark, sf_dir, states=False)), 10, 40).select("id", "name")


def sort_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each of the six orders, in both directions, with its place."""
    rows = dto(spark, sf_dir, states=False).withColumn("state", F.when(F.col("id") % 4 != 0, F.concat(F.lit("S"), (F.col("id") % 50).cast("string"))))
    for key, dim, out in (("fuel_type", D.FUEL_TYPES, "fuel_label"), ("current_stage", D.STAGES, "stage_label")):
        rows = L.label_lookup(rows, D.labels(spark, dim), key, "value", "label", out)
    out = None
    for key in ("name", "fuel", "state", "daysWaiting", "capacity", "stage"):
        for descending in (False, True):
            top = R.page(R.sort_projects(rows, key, descending), 5, 12).select(F.lit(key).alias("key"), F.lit(descending).alias("descending"), "id")
            out = top if out is None else out.unionByName(top)
    return out


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All projects written as JSON, one as text and the files read back."""
    folder = shared_folder(spark, "json")
    filed = F.col("application_filed_date")
    stone = F.array(F.struct(filed.alias("date"), F.lit("exact").alias("date_confidence"), F.col("current_stage").alias("stage"), F.lit('said "so"').alias("description")))
    rows = dto(spark, sf_dir, states=False).withColumn("milestones", F.when(F.col("id") % 3 == 0, stone).otherwise(F.array().cast(N.CHILDREN["milestones"])))
    X.export_json(rows, folder)
    back = spark.read.schema(
        "id long, slug string, name string, application_filed_date string, county string, capacity_value double, is_aggregate_example boolean, cause_slugs array<string>, days_waiting long, "
        "milestones array<struct<date: string, stage: string, description: string>>, investment_waiting struct<applicable: boolean, cost_per_kw: double>"
    ).json(folder)
    text = F.to_json(F.struct("slug", "name", "application_filed_date", "county", "is_aggregate_example", "cause_slugs", "days_waiting", "milestones"), {"ignoreNullFields": "false"})
    return rounded(back.select("id", text.alias("json"), "capacity_value", F.col("investment_waiting.applicable").alias("applicable"), F.col("investment_waiting.cost_per_kw").alias("cost_per_kw")), 6, "capacity_value")


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All projects written as CSV and read back."""
    folder = shared_folder(spark, "csv")
    rows = R.derive(proj(spark, sf_dir).withColumns({"capacity_value": F.floor("capacity_value").cast("double"), "name": F.concat(F.lit('the "'), "name", F.lit('", so called'))}), as_of())
    X.export_csv(rows, D.labels(spark, D.SOURCES), folder)
    back = spark.read.options(header=True, quote='"', escape='"').csv(folder)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (ingest_eia, ingest_lbnl, ingest_pipelines, ingest_counts, overrides_file, exclude_containing, source_in, default_order, sort_orders, json_export, csv_export)
}
