"""The operators as registered queries over the given tables.

``proj`` gives orders the shape of project records, so that the operators run over tables of any size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import presets as P
from .functions import scalars as S
from .functions.classify import code_map_with_override, contains_rules, exact_map, first_match
from .operators import filters as FI
from .operators import lookups as L
from .operators import readmodel as R
from .operators import state as ST
from .plans import normalize as N
from .plans.ingest import dispositions, ingest_summary, normalized, skip_reason
from .plans.snapshots import SnapshotStore, empty_tables, next_state
from .sources import dims as D
from .sources import export as X
from .sources import readers as RD
from .streaming.incremental import incremental_ingest

AS_OF = "2002-01-01"
ENERGY_CODES = ["SUN", "WND", "NG", "NUC", "WAT", "GEO", "MWH", "BAT", "XX"]
STATUSES = {"P": "(P) Planned", "O": "(L) Regulatory approvals pending"}
SHIFTED = {"P": "(L) Regulatory approvals pending", "O": "(U) Under construction"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors see. Only a local session may leave ``spark.checkpoint.dir`` unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession, "cut")
    return df.checkpoint()


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def proj(spark: SparkSession, sf_dir: str, states: bool = True, shift: bool = False) -> DataFrame:
    """Orders in the shape of project records. ``states`` adds the list of nations that an order's lines come from."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    status = exact_map(F.col("o_orderstatus"), SHIFTED if shift else STATUSES, "(P) Planned" if shift else "(U) Under construction")
    code = F.element_at(F.array(*map(F.lit, ENERGY_CODES)), (key % 9 + 1).cast("int"))
    capacity = F.when(key % 11 != 0, F.col("o_totalprice") / 1000)
    fuel = code_map_with_override(code, F.lit(""), P.EIA_TECHNOLOGY_FUEL, P.EIA_FUEL, "other")
    rows = rows.select(
        key.alias("id"),
        F.concat_ws(" ", "c_name", "o_orderpriority").alias("name"),
        status.alias("status"),
        code.alias("energy_code"),
        fuel.alias("fuel_type"),
        F.when(fuel == "storage", "storage").otherwise("generation").alias("project_type"),
        exact_map(S.status_code(status), P.EIA_STAGE, P.DEFAULT_STAGE).alias("current_stage"),
        (F.round(capacity * 1.1, 6) if shift else capacity).alias("capacity_value"),
        F.when(key % 5 == 0, "MMcf/d").otherwise("MW").alias("capacity_unit"),
        F.when(key % 7 != 0, F.col("o_orderdate").cast("timestamp")).alias("application_filed_date"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (key % 97 == 0).alias("is_aggregate_example"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        F.lit(None).cast("string").alias("county"),
        F.lit("verified").alias("verification_status"),
        F.array(F.lit("interconnection_queue_backlog")).alias("cause_slugs"),
        F.lit("eia").alias("source_key"),
    )
    rows = rows.withColumn("slug", S.slugify(F.col("name"), F.concat(F.lit("orders:"), F.col("id").cast("string"))))
    return with_states(spark, sf_dir, rows) if states else rows.withColumn("state", F.lit(None).cast("string"))


def with_states(spark: SparkSession, sf_dir: str, rows: DataFrame, few: bool = False) -> DataFrame:
    """Adds the list of states. ``few``: the rows are a page, so only their lines are gathered."""
    nations = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    if few:
        # a page's ids, as many as its limit says
        lines = lines.join(F.broadcast(rows.select(F.col("id").alias("l_orderkey"))), "l_orderkey", "left_semi")
    lines = lines.join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    listed = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ", ").alias("state"))
    return rows.join(listed, F.col("id") == F.col("l_orderkey"), "left").drop("l_orderkey")


def dto(spark: SparkSession, sf_dir: str, states: bool = True) -> DataFrame:
    return R.derive(proj(spark, sf_dir, states), as_of())


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def filtered_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = FI.FilterState(min_years=3, min_capacity=250, stages=("planned_pre_filing", "regulatory_approvals_pending"), state="NATION_7")
    return rounded(R.filtered_stats(dto(spark, sf_dir), chosen), 2, "total_capacity_mw", "total_investment", "clean_mw")


def aggregate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.aggregate_stats(dto(spark, sf_dir, states=False)), 2, "total_capacity_mw", "total_investment", "clean_mw")


def days_years_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dto(spark, sf_dir, states=False).select("id", "days_waiting", F.round("years_waiting", 6).alias("years_waiting"))


def investment_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("investment_waiting")
    reason = F.when(i["reason"].contains("not in MW"), "unit").when(i["reason"].contains("capital cost"), "fuel").when(i["reason"].isNotNull(), "capacity")
    return dto(spark, sf_dir, states=False).select("id", i["applicable"].alias("applicable"), reason.alias("reason"), F.round(i["estimated_usd"], 2).alias("estimated_usd"), i["cost_per_kw"].alias("cost_per_kw"))


def _ids(name: str, f: FI.FilterState, states: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dto(spark, sf_dir, states).where(FI.matches(f)).select("id")

    query.__name__ = name
    return query


min_years = _ids("min_years", FI.FilterState(min_years=0))
min_capacity = _ids("min_capacity", FI.FilterState(min_capacity=250))
state_contains = _ids("state_contains", FI.FilterState(state="NATION_7"), states=True)
any_of = _ids("any_of", FI.FilterState(fuel_types=("solar", "gas"), project_types=("generation",), stages=("planned_pre_filing",), sources=("eia",)))


def tracked_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.tracked_only(FI.exclude_aggregates(proj(spark, sf_dir, states=False))).select("id", "current_stage")


def capacity_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FI.capacity_floor(proj(spark, sf_dir, states=False)).select("id", "capacity_value")


def disposition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three orders of reasons over the same rows, in one pass."""
    key, status = F.col("id"), F.col("status")
    statuses = {
        "eia": status,
        "ornlHydro": F.when(key % 4 == 0, " Pending Relicense ").otherwise("Issued"),
        "lbnl": F.when(key % 3 == 0, "Active").otherwise("withdrawn"),
    }
    reasons = [F.struct(F.lit(s).alias("source"), skip_reason(s, F.col("capacity_value"), c, status).alias("disposition")) for s, c in statuses.items()]
    each = proj(spark, sf_dir, states=False).select(F.explode(F.array(*reasons)).alias("r"))
    return each.groupBy("r.source", "r.disposition").agg(F.count("*").alias("n"))


PART_RULES = [(r"\b1\b|red", "one"), (r"1", "has_one"), (r"blue|2", "two"), (r"part", "part")]


def classify_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", first_match(F.col("p_name"), PART_RULES, "other").alias("label"))


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title rules over whole texts, which are lower-cased once."""
    text, low = F.col("text"), F.col("low")
    fuel = first_match(text, P.DASHBOARD_TITLE_FUEL, exact_map(F.col("lang"), P.SECTOR_FUEL, "other"), low)
    resource = first_match(text, P.LBNL_RESOURCE_FUEL, "other", low)
    key = first_match(text, P.SOURCE_LABEL_KEY, "other", low)
    stage = contains_rules(text, P.DASHBOARD_STAGE, P.DEFAULT_STAGE, low)
    phase = contains_rules(text, P.LBNL_STAGE, "interconnection_study", low)
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.lower("text").alias("low")).select("doc_id", fuel.alias("title_fuel"), resource.alias("resource_fuel"), key.alias("source_key"), stage.alias("stage"), phase.alias("phase"))


def code_map_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proj(spark, sf_dir, states=False)
    technology = F.when(F.col("id") % 13 == 0, "Offshore Wind Turbine").when(F.col("id") % 17 == 0, "Batteries and storage").otherwise("Turbine")
    fuel = code_map_with_override(F.col("energy_code"), technology, P.EIA_TECHNOLOGY_FUEL, P.EIA_FUEL, "other")
    return rows.select("id", fuel.alias("fuel_type"), FI.is_zero_carbon(fuel).alias("zero_carbon"), F.when(fuel == "storage", "storage").otherwise("generation").alias("project_type"))


def status_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proj(spark, sf_dir, states=False)
    code = S.status_code(F.col("status"))
    word = F.element_at(F.array(*[F.lit(x) for x in ("Announced ", "on hold", "Approved", "construction", "Part Completed", "cancelled", "unheard of")]), (F.col("id") % 7 + 1).cast("int"))
    return rows.select("id", code.alias("code"), exact_map(code, P.EIA_STAGE, P.DEFAULT_STAGE).alias("stage"), exact_map(F.lower(F.trim(word)), P.PIPELINE_STAGE, P.DEFAULT_STAGE).alias("pipeline_stage"))


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("value"), F.col("n_name").alias("label"))
    rows = L.label_lookup(read(spark, sf_dir, "customer"), nations, "c_nationkey", "value", "label", "nation")
    return rows.select("c_custkey", "nation")


def nest_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    lines = lines.select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]
    nested = L.nest_children(orders, lines, "o_orderkey", "l_orderkey", "lines", order, ["l_linenumber", "l_partkey"])
    shown = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",")
    return nested.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), shown.alias("lines"))


def serialize_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.page(R.sort_projects(dto(spark, sf_dir, states=False), "capacity", True), 40, 20)
    page = R.to_summary(with_states(spark, sf_dir, rows.drop("state"), few=True))
    return rounded(page.withColumn("cause_slugs", S.join_list(F.col("cause_slugs"))), 6, "years_waiting", "capacity_value")


def top_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(R.sort_projects(dto(spark, sf_dir, states=False)), 0, 50).select("id", "name", "days_waiting")


def total_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.total_matches(dto(spark, sf_dir, states=False), FI.FilterState(min_years=5, fuel_types=("solar", "hydro")))


def facet_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("label"))
    return R.facet_states(proj(spark, sf_dir), names)


def example_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.example_project(dto(spark, sf_dir, states=False)).select("id", "name", "fuel_type")


def override_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").cast("string").alias("source_id"))
    named = rows.where(F.col("source_id").cast("long") % 10 == 0)
    first = named.withColumns({"line": F.lit(1), "match_key": F.concat(F.lit("merged-"), "source_id")})
    later = named.withColumns({"line": F.lit(2), "match_key": F.lit("ignored")})
    return L.apply_overrides(rows, later.unionByName(first)).select("source", "source_id", "match_key")


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("l_extendedprice"))
    return ST.dedupe_first(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


def _records(rows: DataFrame, *more: str) -> DataFrame:
    """Project-shaped rows as records, with ``more`` of their columns; every third has milestones."""
    key = F.concat(F.lit("orders:"), F.col("id").cast("string"))
    filed = F.col("application_filed_date")
    milestone = F.struct(filed.alias("date"), F.lit("exact").alias("date_confidence"), F.col("current_stage").alias("stage"), F.lit("filed").alias("description"))
    rows = rows.withColumns({"match_key": key, "ordinal": F.col("id"), "sources": F.array(F.struct(F.lit("EIA-860M orders").alias("label"), F.concat(F.lit("https://example.org/"), "slug").alias("url")))})
    rows = rows.withColumn("milestones", F.when(F.col("id") % 3 == 0, F.array(milestone)).otherwise(F.array().cast(N.CHILDREN["milestones"])))
    rows = rows.drop("id")
    return ST.default_fields(rows, N.RECORD | N.CHILDREN | {"ordinal": "long"} | dict.fromkeys(more, "long"))


RUN_1, RUN_2 = "2001-01-01", "2001-02-01"


def _two_runs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    first = proj(spark, sf_dir, states=False).where(F.col("application_filed_date") < F.lit("1999-01-01"))
    second = proj(spark, sf_dir, states=False, shift=True).where(F.col("application_filed_date") >= F.lit("1997-01-01"))
    keep = lambda name, df: cut(df) if name in ("incoming", "projects") else df
    state = next_state(empty_tables(spark), _records(first), F.lit(RUN_1).cast("timestamp"), keep=keep)
    return next_state(state, _records(second), F.lit(RUN_2).cast("timestamp"), keep=keep)


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_runs(spark, sf_dir)["projects"]
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select("id", "slug", F.round("capacity_value", 6).alias("capacity_value"), "current_stage", "verification_status", day("created_at"), day("updated_at"))


def resolved_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = proj(spark, sf_dir, states=False).where(F.col("application_filed_date") < F.lit("1999-01-01"))
    incoming = proj(spark, sf_dir, states=False, shift=True).where(F.col("application_filed_date") >= F.lit("1997-01-01"))
    return ST.remove_resolved(existing, incoming).select("id", "slug")


def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_runs(spark, sf_dir)["milestones"]
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("project_id").alias("projects"))


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", S.slugify(F.concat_ws(" -- ", "c_name", "c_mktsegment"), key).alias("slug"))


def slug_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose brand and size make the same slug."""
    rows = read(spark, sf_dir, "part").select("p_partkey", S.slugify(F.col("p_brand"), F.concat_ws("-", "p_type", F.col("p_size").cast("string"))).alias("slug"))
    return ST.key_collisions(rows, "slug", "p_partkey")


def _nation_points(n: int = 25) -> list[tuple[str, float, float]]:
    return [(f"NATION_{i}", float(i * 3 % 50) - 100, float(i * 7 % 20) + 30) for i in range(n) if i % 6]


def multi_state_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = S.multi_state_centroid(F.col("state"), D.centroid_map(_nation_points()))
    return proj(spark, sf_dir).select("id", F.round(at[0], 6).alias("lon"), F.round(at[1], 6).alias("lat"))


def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proj(spark, sf_dir)
    rows = rows.withColumns({"lat": F.when(F.col("id") % 2 == 0, 40.0), "lon": F.when(F.col("id") % 4 != 3, -90.0)})
    return rounded(R.map_points(rows, D.centroid_map(_nation_points())).select("id", "lon", "lat", "approximate", "radius"), 6, "lon", "lat", "radius")


def geocode_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = read(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0")
    codes = codes.select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("fips5"), (F.col("n_nationkey") + 0.5).alias("lat"), (-F.col("n_nationkey") - 0.25).alias("lon"))
    return L.geocode_by_code(read(spark, sf_dir, "customer"), codes, "c_nationkey").select("c_custkey", "lat", "lon")


CELLS = ["  NA ", "-", "", " 1,234.5 ", "12e2", "abc", "NaN", " 0 "]


def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.element_at(F.array(*map(F.lit, CELLS)), (F.col("o_orderkey") % 8 + 1).cast("int")), F.when(F.col("o_orderkey") % 16 == 3, F.lit(" x")).otherwise(""))
    return read(spark, sf_dir, "orders").select("o_orderkey", S.clean_cell(cell).alias("cell"), S.to_number(cell).alias("number"))


def parse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    serial = (F.datediff(day, F.lit("1899-12-30")) + 0.5).cast("string")
    cell = F.when(F.col("o_orderkey") % 4 == 0, serial).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 2, "NA").otherwise("not a date")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(S.parse_date_cell(cell), "yyyy-MM-dd HH:mm").alias("parsed"))


def excel_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    serial = F.unix_millis(day) / 86_400_000 + 25569
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(S.excel_serial_to_ts(serial), "yyyy-MM-dd HH:mm:ss").alias("back"))


def first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RD.first_link(read(spark, sf_dir, "pages"), "html", "url", '[^"]+').select("page_id", "link")


def latest_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the events as editions: real on days with a purchase; two prefixes, of which the first is there on even days."""
    events = read(spark, sf_dir, "events").select(F.to_date("ts").alias("edition"), (F.col("event_type") == "purchase").alias("ok"))
    days = events.groupBy("edition").agg(F.max("ok").alias("ok"))
    probes = days.select("edition", (F.dayofmonth("edition") % 2).alias("prefix_order"), F.concat(F.lit("https://example.org/"), F.col("edition").cast("string")).alias("url"), "ok", F.lit("application/Spreadsheet").alias("content_type"))
    return RD.latest_edition(probes.withColumn("edition", F.trunc("edition", "month")), F.lit("2024-03-15").cast("timestamp"), 12)


def feed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = read(spark, sf_dir, "region").select(F.concat(F.lit("https://example.org/"), F.lower("r_name")).alias("url"), F.lit("monthly").alias("change_frequency"), F.lit(0.5).alias("priority"))
    projects = R.slim_scan(proj(spark, sf_dir, states=False).withColumn("updated_at", F.col("created_at")))
    feed = X.build_feed(static, projects, "https://example.org")
    return feed.withColumn("last_modified", F.date_format("last_modified", "yyyy-MM-dd"))


def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dto(spark, sf_dir).withColumn("capacity_value", F.floor("capacity_value").cast("double"))
    return R.csv_projection(rows, D.labels(spark, D.SOURCES))


def format_usd_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacities of different sizes, in a unit for some; estimates from dollars to billions."""
    capacity = F.when(F.col("id") % 2 == 0, F.floor("capacity_value") / F.when(F.col("id") % 4 == 0, 8).otherwise(1)).otherwise(F.floor("capacity_value") * 10 + 1)
    rows = R.derive(proj(spark, sf_dir, states=False).withColumn("capacity_value", capacity), as_of())
    scale = F.element_at(F.array(*map(F.lit, (1.0000123, 1.0000123e-3, 1.0000123e-6, 1.0000123e3))), (F.col("id") % 4 + 1).cast("int"))
    rows = rows.withColumns({"investment_waiting": F.col("investment_waiting").withField("estimated_usd", F.col("investment_waiting.estimated_usd") * scale), "capacity_unit": F.when(F.col("id") % 13 != 0, F.col("capacity_unit"))})
    return rows.select("id", S.format_usd(F.col("investment_waiting.estimated_usd")).alias("usd"), S.format_capacity(F.col("capacity_value"), F.col("capacity_unit")).alias("capacity"), S.waiting_label(F.col("years_waiting")).alias("waiting"), S.share_text(F.col("name"), F.col("years_waiting")).alias("share"))


def detail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites and counties for some; a stage that has no label for some."""
    key = F.col("id")
    rows = dto(spark, sf_dir).withColumns({
        "county": F.when(key % 3 == 0, F.concat(F.lit("County "), (key % 10).cast("string"))), "lat": F.when(key % 4 != 0, 30 + (key % 1000) / 1000 + 0.00001), "lon": F.when(key % 6 != 0, -90 - (key % 700) / 1000 - 0.00001),
        "capacity_value": F.floor("capacity_value").cast("double"), "current_stage": F.when(key % 19 == 0, "on_the_way").otherwise(F.col("current_stage")),
    })
    return R.detail_view(rows, D.labels(spark, D.STAGES))


def policy_with_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects under each policy: the cause by fuel, the control group left out."""
    rows = proj(spark, sf_dir, states=False).select((F.col("id") % 7).cast("int").alias("n"))
    slugs = F.element_at(F.array(*[F.lit(s) for s, _, _ in D.CAUSES]), F.col("n") + 1)
    counts = rows.select(slugs.alias("slug")).groupBy("slug").agg(F.count("*").alias("projects"))
    joined = L.policy_with_cause(D.policies(spark), FI.reform_only(D.causes(spark)))
    return counts.join(F.broadcast(joined), "slug").select("slug", "title", "label", "projects")


def encode_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", S.encode_url(F.concat_ws(" + ", "p_name", "p_type")).alias("query"))


def merge_by_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("m"), (F.col("c_custkey") % 100).cast("string")).alias("match_key"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"))
    return ST.merge_by_match_key(rows, ["id"]).select("match_key", "id", "name")


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proj(spark, sf_dir, states=False).withColumn("match_key", F.col("id").cast("string"))
    _, bad = ST.error_rows(rows, [("no capacity", F.col("capacity_value").isNotNull()), ("no filing", F.col("application_filed_date").isNotNull())])
    return bad.groupBy("message").agg(F.count("*").alias("n"))


def normalize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of the planned-generator source, normalised."""
    rows = proj(spark, sf_dir, states=False)
    text = {c: F.lit(None).cast("string") for c in P.HEADERS["eia"]}
    text |= {
        "plant_id": F.col("id").cast("string"), "plant_name": F.col("name"), "generator_id": F.when(F.col("id") % 6 != 0, "G1").otherwise(""),
        "capacity": F.round("capacity_value", 5).cast("string"), "technology": F.lit("Turbine"), "energy_code": F.col("energy_code"),
        "status": F.when(F.col("id") % 8 == 0, "no code").otherwise(F.col("status")), "op_year": F.lit("2030"), "op_month": F.when(F.col("id") % 2 == 0, "6"),
    }
    raw = rows.select(*[v.alias(k) for k, v in text.items()])
    judged = dispositions(raw, "eia")
    records = N.normalize_eia860m(judged.where("disposition = 'keep'"))
    return records.select("source_id", "match_key", "slug", "name", "project_type", "fuel_type", "capacity_value", "current_stage", F.substring_index("data_quality_note", ": ", -1).alias("planned"))


def ingest_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proj(spark, sf_dir, states=False).withColumn("capacity", F.col("capacity_value"))
    judged = dispositions(rows, "eia")
    kept = judged.where("disposition = 'keep'")
    fine, errors = ST.error_rows(kept.withColumn("match_key", F.col("id").cast("string")), [("no filing", F.col("application_filed_date").isNotNull())])
    return ingest_summary(judged, fine, errors)


def serialize_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with causes, sources and milestones made from their order's lines."""
    lines = read(spark, sf_dir, "lineitem").withColumn("project_id", F.col("l_orderkey"))
    causes = lines.select("project_id", F.concat(F.lit("flag_"), "l_returnflag").alias("cause_slug")).distinct()
    label = F.element_at(F.array(F.lit("LBNL Queued Up"), F.lit("ORNL HydroSource"), F.lit("a list")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    sources = lines.where("l_linenumber <= 2").groupBy("project_id", F.col("l_linenumber").alias("ordinal")).agg(F.min(label).alias("label"), F.min(F.col("l_partkey").cast("string")).alias("url"))
    stones = lines.select("project_id", F.col("l_shipdate").cast("timestamp").alias("date"), F.lit("exact").alias("date_confidence"), F.col("l_linestatus").alias("stage"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("description"))
    rows = R.serialize_projects(proj(spark, sf_dir, states=False).drop("cause_slugs", "source_key"), causes, sources, stones, as_of())
    return rows.select(
        "id", F.array_join("cause_slugs", "|").alias("causes"), F.array_join(F.transform("sources", lambda x: x["url"]), ",").alias("sources"), "source_key",
        F.array_join(F.transform("milestones", lambda m: F.concat_ws(":", F.date_format(m["date"], "yyyyMMdd"), m["stage"], m["description"])), ",").alias("milestones"), "days_waiting",
    )


def get_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project with the first slug of the table, looked up by that slug."""
    rows = proj(spark, sf_dir, states=False)
    wanted = rows.agg(F.min("slug")).first()[0]
    return R.get_project(rows, wanted).select("id", "slug", "name", "current_stage")


def ingest_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as a relicensing sheet, read back as text, resolved, decided and normalised."""
    rows, folder = proj(spark, sf_dir, states=False), shared_folder(spark, "sheet")
    cells = {h[0]: F.lit(None).cast("string") for h in P.HEADERS["ornlHydro"].values()}
    day = F.date_format("application_filed_date", "yyyy-MM-dd")
    cells |= {
        " FERC_docket ": F.concat(F.lit("P-"), F.col("id").cast("string")), "Project_name": F.concat(F.lit('Dam "'), "name", F.lit('", phase 1')), "State": F.lit("WA"),
        "Status": F.when(F.col("id") % 4 == 0, "Issued").otherwise(" Pending Relicense"), "Capacity_new_MW": F.round("capacity_value", 5).cast("string"),
        "NOI_date": F.when(F.col("id") % 3 == 0, "43511").otherwise("NA"), "Application_date": F.when(F.col("id") % 2 == 0, day), "Proc_type": F.when(F.col("id") % 5 == 0, "ILP").otherwise("NA"),
    }
    cells.pop("FERC_docket")
    rows.select(*[v.alias(k) for k, v in cells.items()]).write.options(header=True, escape='"').csv(folder)
    out = normalized(spark, "ornlHydro", folder).records
    return out.select("source_id", "name", "capacity_value", F.date_format("application_filed_date", "yyyy-MM-dd").alias("filed"), "current_status", "current_stage", F.col("data_quality_note").isNotNull().alias("noted"))


def ingest_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as the dashboard's JSON, each twice; sectors are filtered at the source, repeats dropped, fuels inferred."""
    rows, folder = proj(spark, sf_dir, states=False), shared_folder(spark, "dashboard")
    title = F.element_at(F.array(*[F.lit(x) for x in ("LNG terminal", "Solar and storage", "Upwind ranch", "Amsterdam works", "plain")]), (F.col("id") % 5 + 1).cast("int"))
    sector = F.element_at(F.array(*[F.lit(x) for x in [*P.SECTOR_TYPE, "Ports"]]), (F.col("id") % 6 + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("Complete", "Withdrawn", "Under Construction", "Paused")]), (F.col("id") % 4 + 1).cast("int"))
    landed = rows.select(
        F.col("id").cast("string").alias("project_id"), title.alias("project_title"), sector.alias("project_sector"), status.alias("project_field_project_status"),
        F.when(F.col("id") % 7 == 0, "BLM").alias("project_field_project_lead_agency"), F.when(F.col("id") % 2 == 0, F.struct(F.lit("http://x").alias("url"))).alias("project_url"),
    )
    landed.union(landed).write.json(folder)
    out = normalized(spark, "permittingDashboard", folder).records
    return out.select("source_id", "name", "project_type", "fuel_type", "current_status", "current_stage", F.col("sources")[0]["url"].alias("url"))


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed in three editions of several files, the last one with changes; the final state of the store."""
    root = shared_folder(spark, "incremental")
    store = SnapshotStore(spark, f"{root}/state")
    parts = [(proj(spark, sf_dir, False).where(F.col("id") % 2 == 0)), (proj(spark, sf_dir, False).where(F.col("id") % 2 == 1)), (proj(spark, sf_dir, False, shift=True).where(F.col("id") % 5 == 0))]
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(f"{root}/landing")
        day = F.lit(f"2001-01-0{i + 1}").cast("timestamp")
        for _ in range(2):  # the second call finds nothing new
            incremental_ingest(spark, f"{root}/landing", part.schema, _records, store, f"{root}/stream", day)
    rows = store.read()["projects"]
    return rows.select("slug", "current_stage", F.round("capacity_value", 6).alias("capacity_value"), F.date_format("created_at", "yyyy-MM-dd").alias("created_at"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated_at"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        filtered_stats, aggregate_stats, days_years_waiting, investment_waiting, min_years, min_capacity, state_contains, any_of, tracked_only, capacity_floor,
        disposition_counts, classify_first_match, classify_documents, code_map_override, status_stage, label_lookup, nest_children, serialize_page, top_waiting,
        total_matches, facet_states, example_project, override_keys, dedupe_first, upsert_snapshot, resolved_delete, replace_children, slugify, slug_collisions,
        multi_state_centroid, map_points, geocode_by_code, clean_cells, parse_cells, excel_serial, first_link, latest_edition, feed_union, csv_projection,
        format_usd_capacity, detail_view, policy_with_cause, encode_url, merge_by_match_key, error_rows, normalize_all,
        serialize_projects, get_project, ingest_sheet, ingest_dashboard,
    )
} | {"ingest_summary": ingest_summary_query, "incremental_ingest": incremental}
