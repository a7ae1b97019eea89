"""Registered queries over a store that runs change in place: buckets, changes, kept statistics, an index, past versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import presets as P
from .operators import deltas
from .operators import filters as FI
from .operators import lookups as L
from .operators import readmodel as R
from .plans.buckets import BucketStore
from .plans.observed import land
from .queries import RUN_1, RUN_2, _records, cut, dto, proj, shared_folder
from .sources import dims as D
from .sources.dashboard import land_by_sector, scan_sectors
from .sources.readers import DASHBOARD_SCHEMA, ORDINAL
from .streaming.stateful import stateful_ingest

BUCKETS = 16


def two_runs(spark: SparkSession, sf_dir: str) -> BucketStore:
    """The orders filed before 1999, then those from 1997 on with changes; a project is in up to three states."""
    store = BucketStore(spark, shared_folder(spark, "buckets"), BUCKETS)
    states = lambda df: df.withColumn("state", F.when(F.col("id") % 9 != 0, F.concat(F.lit("S"), (F.col("id") % 50).cast("string"), F.lit(", S"), (F.col("id") % 7).cast("string"), F.lit(","))))
    first = states(proj(spark, sf_dir, states=False)).where(F.col("application_filed_date") < F.lit("1999-01-01"))
    second = states(proj(spark, sf_dir, states=False, shift=True)).where(F.col("application_filed_date") >= F.lit("1997-01-01"))
    store.apply(_records(first), F.lit(RUN_1).cast("timestamp"))
    store.apply(_records(second), F.lit(RUN_2).cast("timestamp"))
    return store


def _shown(rows: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select("id", "slug", F.round("capacity_value", 6).alias("capacity_value"), "current_stage", "verification_status", day("created_at"), day("updated_at"))


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"total_capacity_mw": F.round("total_capacity_mw", 2), "total_investment": F.round("total_investment", 0), "clean_mw": F.round("clean_mw", 2)})


def upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs in buckets give what two rewrites of the whole state give."""
    return _shown(two_runs(spark, sf_dir).read()["projects"])


def bucket_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milestones, causes and sources after two runs, by the stage of their project."""
    tables = two_runs(spark, sf_dir).read()
    of = tables["projects"].select(F.col("id").alias("project_id"), "current_stage")
    counts = None
    for name in ("milestones", "project_causes", "project_sources"):
        rows = tables[name].join(of, "project_id").groupBy(F.lit(name).alias("child"), F.col("current_stage").alias("stage")).agg(F.count("*").alias("n"), F.countDistinct("project_id").alias("projects"))
        counts = rows if counts is None else counts.unionByName(rows)
    return counts


def past_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projects as they were before the last run."""
    store = two_runs(spark, sf_dir)
    return _shown(store.read(store.version() - 1)["projects"])


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second run did to each project it touched."""
    feed = two_runs(spark, sf_dir).changes(2)
    what = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return feed.select("slug", what.alias("change"), F.col("old.current_stage").alias("old_stage"), F.col("new.current_stage").alias("new_stage"))


def delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of all projects after two runs, from what each run added to those before."""
    out = deltas.stats(two_runs(spark, sf_dir).stats())
    return _rounded(out)


def delta_filtered_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of some fuels and stages."""
    chosen = FI.FilterState(fuel_types=("solar", "nuclear", "gas"), stages=("planned_pre_filing", "regulatory_approvals_pending"), project_types=("generation",))
    out = deltas.stats(two_runs(spark, sf_dir).stats(), chosen)
    return _rounded(out)


def state_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of a state after two runs, by the index that the runs kept."""
    return two_runs(spark, sf_dir).with_state("S5").select("id", "slug", "state")


def stateful_ingest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed three times: all of them; then a fifth with changes, and a tenth that is late and says what no longer
    holds; then the same fifth again. The state of the store in the end, and how many versions the landings made."""
    root = shared_folder(spark, "stateful")
    store = BucketStore(spark, f"{root}/state", BUCKETS)
    old, new = proj(spark, sf_dir, states=False), proj(spark, sf_dir, states=False, shift=True)
    fifth = new.where(F.col("id") % 5 == 0)
    late = old.where(F.col("id") % 10 == 0).withColumn("capacity_value", F.lit(-1.0))
    landings = [[(old, 10)], [(fifth, 30), (late, 5)], [(fifth, 40)]]
    for day, parts in enumerate(landings, 1):
        for part, edition in parts:
            part.withColumn("edition", F.lit(edition)).write.mode("append").parquet(f"{root}/landing")
        schema = old.withColumn("edition", F.lit(0)).schema
        for _ in range(2):  # the second call finds nothing new
            stateful_ingest(spark, f"{root}/landing", schema, lambda df: _records(df, "edition"), store, f"{root}/stream", F.lit(f"2001-01-0{day}").cast("timestamp"), F.col("edition"), partitions=32)
    rows = store.read()["projects"]
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select("slug", "current_stage", F.round("capacity_value", 6).alias("capacity_value"), day("created_at"), day("updated_at"), F.lit(store.version()).cast("long").alias("versions"))


def seek_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three pages of each of the six orders, in both directions, each page found from where the last one ended."""
    rows = dto(spark, sf_dir, states=False).withColumn("state", F.when(F.col("id") % 4 != 0, F.concat(F.lit("S"), (F.col("id") % 50).cast("string"))))
    for key, dim, out in (("fuel_type", D.FUEL_TYPES, "fuel_label"), ("current_stage", D.STAGES, "stage_label")):
        rows = L.label_lookup(rows, D.labels(spark, dim), key, "value", "label", out)
    rows = cut(rows.select("id", "created_at", "name", "state", "days_waiting", "capacity_value", "fuel_label", "stage_label"))
    pages = None
    for key in ("name", "fuel", "state", "daysWaiting", "capacity", "stage"):
        for descending in (False, True):
            at = None
            for number in (1, 2, 3):
                page = R.page_after(rows, key, descending, at, 8)
                at = R.cursor_of(page, key, descending)
                shown = page.select(F.lit(key).alias("key"), F.lit(descending).alias("descending"), F.lit(number).alias("page"), "id")
                pages = shown if pages is None else pages.unionByName(shown)
    return pages


def sheet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as relicensing sheets whose files differ in the order of their columns, with cells of two lines and a
    broken line for some; read back and normalised."""
    key, folder = F.col("id"), shared_folder(spark, "sheets")
    rows = proj(spark, sf_dir, states=False)
    cells = {h[0]: F.lit(None).cast("string") for h in P.HEADERS["ornlHydro"].values()}
    cells |= {
        "FERC_docket": F.concat(F.lit("P-"), key.cast("string")), "Project_name": F.concat(F.lit('Dam "A",\n'), "name"), "State": F.lit("WA"), "Status": F.lit("Pending Relicense"),
        "Capacity_new_MW": F.when(key % 3 == 0, F.format_number("capacity_value", 5)).otherwise(F.round("capacity_value", 5).cast("string")), "Application_date": F.date_format("application_filed_date", "yyyy-MM-dd"),
    }
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    for i, names in enumerate((list(cells), list(cells)[::-1])):
        line = F.concat_ws(",", *[quoted(cells[n]) for n in names])
        lines = F.when(key % 41 == i, F.array(line, F.lit('"lost quote'))).otherwise(F.array(line))
        first = F.monotonically_increasing_id() % (1 << 33) == 0  # of each file
        part = rows.where(key % 2 == i).select(first.alias("first"), lines.alias("lines"))
        part.select(F.explode(F.when(F.col("first"), F.concat(F.array(F.lit(",".join(names))), "lines")).otherwise(F.col("lines")))).write.mode("append").text(folder)
    out = land(spark, "ornlHydro", folder, shared_folder(spark, "landed"))
    counts = out.summary.first()
    shown = out.records.select("source_id", "name", "capacity_value", F.date_format("application_filed_date", "yyyy-MM-dd").alias("filed"))
    return shown.withColumns({"errors": F.lit(counts["errors"]).cast("long"), "below_floor": F.lit(counts["skipped_below_floor"]).cast("long")})


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as the dashboard's JSON, some lines cut off; what went on, what was kept back and why."""
    key, folder = F.col("id"), shared_folder(spark, "dashboard")
    line = F.to_json(F.struct(key.cast("string").alias("project_id"), F.when(key % 13 != 0, F.concat(F.lit("Solar "), key.cast("string"))).alias("project_title"),
        F.lit("Renewable Energy Production").alias("project_sector"), F.when(key % 4 == 0, "Complete").otherwise("Paused").alias("project_field_project_status")))
    proj(spark, sf_dir, states=False).select(F.when(key % 17 == 0, F.substring(line, 1, 30)).otherwise(line).alias("line")).write.text(folder)
    out = land(spark, "permittingDashboard", folder, shared_folder(spark, "landed"))
    kept = out.quarantine.agg(F.count_if(F.col("message") == "no row of the dataset").alias("unread"), F.count_if(F.col("text").startswith("{") & F.col("file").isNotNull()).alias("with_text"))
    return kept.withColumns({c: F.lit(n).cast("long") for c, n in out.summary.first().asDict().items()})


def sector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as the dashboard's rows by sector; a scan of two of six sectors."""
    key, folder = F.col("id"), shared_folder(spark, "sectors")
    sector = F.element_at(F.array(*[F.lit(x) for x in [*P.SECTOR_TYPE, "Ports"]]), (key % 6 + 1).cast("int"))
    given = {"project_id": key.cast("string"), "project_title": F.col("name"), "project_sector": sector}
    place = F.struct(F.lit("orders").alias("file"), F.lit(0).cast("long").alias("block"), key.alias("line")).alias(ORDINAL)
    rows = proj(spark, sf_dir, states=False).select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in DASHBOARD_SCHEMA], place)
    land_by_sector(rows, folder)
    return scan_sectors(spark, folder, ["Pipelines", "Ports"]).select("project_id", "project_title", "project_sector")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (upsert_buckets, bucket_children, past_version, change_feed, delta_stats, delta_filtered_stats, state_index, seek_pages, sheet_source, quarantine, sector_scan)
} | {"stateful_ingest": stateful_ingest_query}
