"""Filters, lookups, state, read model, sources, plans and streaming."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattline.functions import presets as P
from wattline.operators import filters as FI
from wattline.operators import lookups as L
from wattline.operators import readmodel as R
from wattline.operators import state as ST
from wattline.plans import ingest as I
from wattline.plans.normalize import CHILDREN, RECORD
from wattline.plans.snapshots import SnapshotStore, empty_tables, next_state
from wattline.sources import dims as D
from wattline.sources import export as X
from wattline.sources import readers as RD
from wattline.streaming.incremental import incremental_ingest

DTO = "id string, name string, fuel_type string, project_type string, capacity_value double, capacity_unit string, current_stage string, source_key string, state string, years_waiting double, days_waiting long, created_at timestamp, is_aggregate_example boolean, lat double, lon double"


def dto(spark, *rows):
    base = dict(name="n", fuel_type="solar", project_type="generation", capacity_value=300.0, capacity_unit="MW", current_stage="agency_permitting", source_key="eia", state="TX", years_waiting=2.0, days_waiting=730, created_at=dt.datetime(2020, 1, 1), is_aggregate_example=False, lat=None, lon=None)
    names = [c.split()[0] for c in DTO.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": str(i)} | r)[c] for c in names) for i, r in enumerate(rows)], DTO)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_filters(spark):
    rows = dto(spark, {}, {"years_waiting": None}, {"capacity_value": None}, {"state": "NY,TX, MX"}, {"state": None}, {"capacity_unit": "MMcf/d"}, {"fuel_type": "gas"})
    pick = lambda **k: ids(rows.where(FI.matches(FI.FilterState(**k))))
    assert pick() == ids(rows) and not FI.FilterState().has_active() and FI.FilterState(min_years=0).has_active()
    assert pick(min_years=0) == ["0", "2", "3", "4", "5", "6"]
    assert pick(min_capacity=250) == ["0", "1", "3", "4", "5", "6"]
    assert pick(state="TX") == ["0", "1", "2", "3", "5", "6"] and pick(state="MX") == ["3"] and pick(state="") == [] and pick(state="tx") == []
    assert pick(fuel_types=("gas",)) == ["6"] and pick(sources=("lbnl",)) == [] and pick(stages=("agency_permitting",), project_types=("storage",)) == []
    assert ids(FI.capacity_floor(rows.withColumn("capacity_value", F.when(F.col("id") != 2, F.lit(249.9))))) == ["2"]


def test_status_predicates(spark):
    rows = spark.createDataFrame([("Active",), ("active ",), ("withdrawn",), (None,)], "s string")
    assert [r[0] for r in rows.select(FI.status_is(F.col("s"), "active")).collect()] == [True, False, False, False]
    rows = spark.createDataFrame([("IA Executed",), ("Facility Study",), ("",), (None,)], "p string")
    assert [r["p"] for r in FI.exclude_containing(rows, "p", P.LBNL_CLEARED).collect()] == ["Facility Study", "", None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(0, 500)), st.sampled_from(["(P) a", "x", None])), max_size=12))
def test_dispositions_partition_rows(spark, rows):
    frame = spark.createDataFrame([(None if c is None else str(c), s) for c, s in rows], "capacity string, status string")
    counts = {r["disposition"]: r["count"] for r in I.dispositions(frame, "eia").groupBy("disposition").count().collect()}
    assert sum(counts.values()) == len(rows) and set(counts) <= {"keep", "below_floor", "not_waiting"}


def test_disposition_order(spark):
    row = spark.createDataFrame([("1", "withdrawn", "IA Executed")], "capacity string, status string, ia_phase string")
    of = lambda s: I.dispositions(row, s).first()["disposition"]
    assert (of("lbnl"), of("eia"), of("ornlHydro")) == ("not_active", "below_floor", "below_floor")


def test_lookups(spark):
    rows = spark.createDataFrame([("eia", "1"), ("eia", "2")], "source string, source_id string")
    over = spark.createDataFrame([("eia", "1", "second", 2), ("eia", "1", "first", 1)], "source string, source_id string, match_key string, line long")
    assert {r["source_id"]: r["match_key"] for r in L.apply_overrides(rows, over).collect()} == {"1": "first", "2": "eia:2"}
    places = spark.createDataFrame([("04005", 1.0, 2.0)], "fips5 string, lat double, lon double")
    codes = spark.createDataFrame([("4005",), (" 04005",), ("004005",), ("9",), (None,)], "code string")
    assert [r["lat"] for r in L.geocode_by_code(codes, places, "code").orderBy(F.col("code").asc_nulls_last()).collect()] == [1.0, None, 1.0, None, None]
    parent, child = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "pid string, n int, v string")
    got = {r["id"]: [x["v"] for x in r["kids"]] for r in L.nest_children(parent, child, "id", "pid", "kids", ["n"], ["v"]).collect()}
    assert got == {"a": ["x", "y"], "b": []}
    assert L.policy_with_cause(D.policies(spark), D.causes(spark)).count() == 6 and FI.reform_only(D.causes(spark)).count() == 6


def test_stats_and_order(spark):
    rows = R.derive(dto(spark, {"capacity_value": 10.0}, {"capacity_unit": "MMcf/d"}, {"fuel_type": "gas", "capacity_value": None}, {"is_aggregate_example": True}).withColumn("application_filed_date", F.col("created_at")), F.lit(dt.datetime(2021, 1, 1)))
    got = R.aggregate_stats(rows).first().asDict()
    assert got == {"total_projects": 3, "total_capacity_mw": 10.0, "total_investment": 13270000.0, "investment_count": 1, "clean_mw": 10.0, "clean_count": 1}
    assert list(R.aggregate_stats(rows.where("false")).first()) == [0, 0.0, 0.0, 0, 0.0, 0]
    assert R.example_project(rows).first()["id"] == "0" and R.example_project(rows.where("is_aggregate_example")).count() == 0
    order = dto(spark, {"days_waiting": None}, {"days_waiting": 5}, {"days_waiting": 5}, {"days_waiting": 9})
    assert [r["id"] for r in R.sort_projects(order).collect()] == ["3", "1", "2", "0"]
    assert [r["id"] for r in R.sort_projects(order, "daysWaiting", False).collect()] == ["0", "1", "2", "3"]
    names = dto(spark, {"name": "Éa"}, {"name": "_z"}, {"name": "A"}, {"name": "a"}, {"name": "f"})
    assert [r["name"] for r in R.sort_projects(names, "name", False).collect()] == ["_z", "a", "A", "Éa", "f"]
    pages = [r["id"] for o in (0, 2, 4) for r in R.page(R.sort_projects(order), o, 2).collect()]
    assert pages == ["3", "1", "2", "0"]
    facets = R.facet_states(dto(spark, {"state": "NY,TX"}, {"state": "ZZ"}, {"state": None}), D.states(spark).select("value", "label"))
    assert [(r["code"], r["name"]) for r in facets.collect()] == [("NY", "New York"), ("TX", "Texas"), ("ZZ", "ZZ")]


def test_map_points(spark):
    rows = dto(spark, {"lat": 1.0, "lon": 2.0}, {"lat": 1.0, "state": "NY,CT"}, {"lat": 1.0, "state": "NY"}, {"state": "ZZ,YY"})
    got = {r["id"]: (r["approximate"], r["radius"]) for r in R.map_points(rows, D.centroid_map()).collect()}
    assert got == {"0": (False, pytest.approx(6.928, abs=0.01)), "1": (True, pytest.approx(6.928, abs=0.01))}


def test_source_key(spark):
    kind = CHILDREN["sources"]
    rows = spark.createDataFrame([([("EIA-860M x", "u"), ("LBNL Queued Up", "u")],), ([("nothing", "u")],), ([],), (None,)], f"sources {kind}")
    assert [r[0] for r in rows.select(R.source_key(F.col("sources"))).collect()] == ["eia", "other", "other", "other"]


# ------------------------------------------------------------------ state


def record(spark, *rows):
    base = {c: None for c in RECORD | CHILDREN} | {"name": "n", "current_stage": "agency_permitting", "is_aggregate_example": False, "cause_slugs": [], "sources": [("l", "u")], "milestones": []}
    kinds = RECORD | CHILDREN | {"ordinal": "long"}
    return spark.createDataFrame([tuple((base | {"ordinal": i} | r)[c] for c in kinds) for i, r in enumerate(rows)], ", ".join(f"{c} {t}" for c, t in kinds.items()))


def day(n):
    return F.lit(dt.datetime(2024, 1, n))


MILESTONE = [(dt.datetime(2020, 1, 1), "exact", "s", "d")]


def test_two_runs(spark):
    first = record(spark, {"slug": "a", "milestones": MILESTONE, "cause_slugs": ["x", "x"]}, {"slug": "b", "milestones": MILESTONE}, {"slug": "c"}, {"slug": "f", "milestones": MILESTONE})
    state = next_state(empty_tables(spark), first, day(1))
    assert state["projects"].count() == 4 and state["project_causes"].count() == 1
    second = record(
        spark, {"slug": "a", "name": "new", "cause_slugs": ["y"]}, {"slug": "b", "current_stage": "under_construction"}, {"slug": "d"}, {"slug": "e", "name": "early"},
        {"slug": "e", "name": "late"}, {"slug": "f", "milestones": MILESTONE + [(dt.datetime(2021, 1, 1), "exact", "s", "d")]}, {"slug": "g", "current_stage": "cancelled"},
    )
    after = next_state(state, second, day(2))
    got = {r["slug"]: r for r in after["projects"].collect()}
    assert sorted(got) == ["a", "c", "d", "e", "f"]
    old = {r["slug"]: r for r in state["projects"].collect()}
    assert got["a"]["id"] == old["a"]["id"] and got["a"]["created_at"].day == 1 and got["a"]["updated_at"].day == 2 and got["a"]["name"] == "new"
    assert got["c"]["updated_at"].day == 1 and got["e"]["name"] == "late" and got["d"]["verification_status"] == "verified"
    stones = {r["project_id"]: r["count"] for r in after["milestones"].groupBy("project_id").count().collect()}
    assert stones == {got["a"]["id"]: 1, got["f"]["id"]: 2}
    assert [(r["project_id"], r["cause_slug"]) for r in after["project_causes"].collect()] == [(got["a"]["id"], "y")]
    again = next_state(after, second, day(3))
    shown = lambda t: sorted(map(str, t["projects"].drop("updated_at").collect()))
    assert shown(again) == shown(after)


def test_error_rows_and_collisions(spark):
    rows = spark.createDataFrame([("k1", "s", 1.0), ("k2", "s", None), ("k3", None, None)], "match_key string, slug string, v double")
    fine, bad = ST.error_rows(rows, [("no slug", F.col("slug").isNotNull()), ("no value", F.col("v").isNotNull())])
    assert [r["match_key"] for r in fine.collect()] == ["k1"] and {r["match_key"]: r["message"] for r in bad.collect()} == {"k2": "no value", "k3": "no slug"}
    assert [tuple(r) for r in ST.key_collisions(rows, "slug", "match_key").collect()] == [("s", 2, "k1", "k2")]
    assert [tuple(r) for r in ST.merge_by_match_key(rows.select(F.lit("m").alias("match_key"), F.col("match_key").alias("k"), "v"), ["k"]).collect()] == [("m", "k1", 1.0)]
    assert ST.dedupe_first(rows, ["slug"], ["match_key"]).count() == 2


# ------------------------------------------------------------------ sources and plans


def land(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


EIA = 'Entity ID, Plant ID ,Plant Name,Plant State,County,Generator ID,Nameplate Capacity (MW),Technology,Energy Source Code,Planned Operation Month,Planned Operation Year,Status,Latitude,Longitude'


def test_read_and_resolve(spark, tmp_path):
    path = land(tmp_path / "eia.csv", "Inventory of planned generators", ",,,", EIA, '1,10,"Big, Sunny",TX,Travis,G1,300,Solar,SUN,6,2027,(P) Planned,30.1,-97.2', ",,,,,,,,,,,,,", "1,11,Small,TX,,,249.9,Solar,SUN,,2027,(P) Planned,,", "1,12,Odd,TX,,G2,\"1,200.0\",Offshore Wind Turbine,WND,,,(ZZ) New,,", "1,13,None,TX,,G2,,x,XX,,,no code,,", "1,14,Zero,TX,,G3,0,Solar,SUN,,,(P) x,,")
    rows = RD.resolve_columns(RD.read_sheet_export(spark, path, 2), P.HEADERS["eia"])
    assert rows.count() == 5 and rows.columns == [*P.HEADERS["eia"], RD.ORDINAL]
    with pytest.raises(ValueError, match="status.*lat"):
        RD.resolve_columns(rows.select(F.col("state").alias("State")), {"status": ["Status"], "state": ["State"], "lat": ["Latitude"]})
    out = I.normalized(spark, "eia", path)
    got = {r["source_id"]: r for r in out.records.collect()}
    assert sorted(got) == ["10-G1", "12-G2"]
    big, odd = got["10-G1"], got["12-G2"]
    assert (big["name"], big["fuel_type"], big["current_stage"], big["capacity_value"], big["match_key"]) == ("Big, Sunny (Unit G1)", "solar", "planned_pre_filing", 300.0, "eia:10-G1")
    assert (odd["fuel_type"], odd["current_stage"], odd["capacity_value"]) == ("wind_offshore", "agency_permitting", 1200.0)
    assert "6/2027" in big["data_quality_note"] and "unknown" in odd["data_quality_note"]
    s = out.summary.first().asDict()
    assert (s["upserted"], s["skipped_below_floor"], s["skipped_not_waiting"], s["errors"]) == (2, 2, 1, 0)


def test_other_sources(spark, tmp_path):
    lbnl = land(tmp_path / "lbnl.csv", "Queue data", "q_id,q_status,entity,state,county,fips_code,type_clean,mw_1,mw_2,q_date,wd_date,ia_date,on_date,IA_phase_clean,region",
                "7,Active,ISO,TX,Bee,4005,Solar+Battery,300,,43511,,,,Facility Study,West", "8,active ,ISO,TX,,,Wind,300,,,,,,,", "9,ACTIVE,ISO,TX,,,Wind,300,,,,,,IA Executed,", "6,active,ISO,TX,,,Coal,,,NA,,,,,")
    places = spark.createDataFrame([("04005", 1.0, 2.0)], "fips5 string, lat double, lon double")
    out = I.normalized(spark, "lbnl", lbnl, centroids=places)
    got = {r["source_id"]: r for r in out.records.collect()}
    assert sorted(got) == ["ISO-6", "ISO-7"] and got["ISO-7"]["lat"] == 1.0 and got["ISO-7"]["application_filed_date"] == dt.datetime(2019, 2, 15)
    assert got["ISO-7"]["current_status"] == "Interconnection queue status: active (Facility Study), West region" and got["ISO-6"]["fuel_type"] == "other"
    s = out.summary.first()
    assert (s["skipped_not_active"], s["skipped_already_cleared"]) == (1, 1)

    ornl = land(tmp_path / "ornl.csv", "FERC_docket,Project_name,Project_licensee,Waterway,Project_type,Latitude,Longitude,State,NOI_date,Application_date,Proc_type,Status,Capacity_new_MW",
                "P-1,Dam,Co,River,x,,,WA,43511,NA,NA, Pending Relicense ,300", "P-2,Dam2,Co,River,x,1,2,WA,43511,43512,ILP,Submitted NOI to Relicense,", "P-3,Dam3,Co,River,x,1,2,WA,,,,Issued,300")
    got = {r["source_id"]: r for r in I.normalized(spark, "ornlHydro", ornl).records.collect()}
    assert sorted(got) == ["P-1", "P-2"] and got["P-1"]["lat"] is None and got["P-1"]["data_quality_note"] and not got["P-2"]["data_quality_note"]
    assert got["P-1"]["current_status"] == "FERC relicensing: Pending Relicense" and got["P-2"]["current_status"].endswith("(ILP process)")

    pipes = land(tmp_path / "pipes.csv", "Projects", "Project Name,Pipeline Operator Name,Project Type,Status,Year In Service Date,State(s),Cost (millions),Miles,Additional Capacity (MMcf/d),Pipeline Type,Authority,Docket/Permit  Number,Demand Served,Website",
                 'Line,Op,New,Approved ,2026,"NY,CT",12,,500,Interstate,FERC,CP-1,x,y', "Line2,,New,unheard,na,TX,,30,-,,,-,x,y", "Line3,Op,New,NA,,,,,,,,,x,y")
    got = {r["source_id"]: r for r in I.normalized(spark, "eiaPipelines", pipes).records.collect()}
    assert sorted(got) == ["-Line2", "CP-1"] and got["CP-1"]["current_stage"] == "approved_awaiting_construction" and got["CP-1"]["state"] == "NY,CT"
    assert got["-Line2"]["capacity_value"] is None and "30 miles" in got["-Line2"]["data_quality_note"] and "$12 million" in got["CP-1"]["data_quality_note"]

    dash = land(tmp_path / "dash.json", *['{"project_id":"1","project_title":"Solar and storage","project_sector":"Energy Storage","project_field_project_status":"Paused","project_field_project_lead_agency":"BLM"}'] * 3,
                '{"project_id":"2","project_title":"Thing","project_sector":"Pipelines","project_url":{"url":"http://x"}}', '{"project_id":"3","project_title":"Port","project_sector":"Ports"}')
    got = {r["source_id"]: r for r in I.normalized(spark, "permittingDashboard", dash).records.collect()}
    assert sorted(got) == ["1", "2"] and got["1"]["current_status"] == "Paused (lead: BLM)" and got["1"]["fuel_type"] == "solar" and got["1"]["project_type"] == "storage"
    assert got["2"]["fuel_type"] == "pipeline" and got["2"]["sources"][0]["url"] == "http://x" and got["2"]["current_status"] == "Unknown" and got["1"]["sources"][0]["url"].endswith("/1")


def test_overrides_file(spark, tmp_path):
    path = land(tmp_path / "o.csv", "source,sourceId,matchKey", " eia , 10-G1 , merged ", "", "eia,10-G1,late")
    rows = RD.read_overrides(spark, path).orderBy("line").collect()
    assert [(r["source"], r["source_id"], r["match_key"]) for r in rows] == [("eia", "10-G1", "merged"), ("eia", "10-G1", "late")]
    assert RD.read_overrides(spark, str(tmp_path / "none.csv")).count() == 0 and RD.read_overrides(spark, None).count() == 0


def test_links(spark):
    pages = spark.createDataFrame(
        [(1, "https://h.org/a/b.html", '<A HREF="/x/File.XLSX">'), (2, "https://h.org/a/b", '<a href="q.txt"><a href="f.xlsx">'), (3, "https://h.org", '<a href="f.xlsx">'), (4, "https://h.org/", "none"), (5, "http://h.org/a", '<a href="//c.org/f.xlsx">'), (6, "http://h.org/a", '<a href="https://d.org/f.xlsx">')],
        "i int, url string, html string",
    )
    got = [r["link"] for r in RD.first_link(pages, "html", "url", r'[^"]+\.xlsx').orderBy("i").collect()]
    assert got == ["https://h.org/x/File.XLSX", "https://h.org/a/f.xlsx", "https://h.org/f.xlsx", None, "http://c.org/f.xlsx", "https://d.org/f.xlsx"]


def test_editions(spark):
    sheet = "application/vnd.ms-Spreadsheet"
    probes = spark.createDataFrame([(dt.date(2024, 3, 1), 0, "m3", True, "text/html"), (dt.date(2024, 2, 1), 1, "m2b", True, sheet), (dt.date(2024, 2, 1), 0, "m2a", False, sheet), (dt.date(2024, 1, 1), 0, "m1", True, sheet)], "edition date, prefix_order int, url string, ok boolean, content_type string")
    assert RD.latest_edition(probes, F.lit(dt.datetime(2024, 3, 9)), 6).first()["url"] == "m2b"
    with pytest.raises(ValueError):
        RD.latest_edition(probes, F.lit(dt.datetime(2022, 3, 9)), 6)


def test_export(spark, tmp_path):
    rows = dto(spark, {"name": 'say "x"', "capacity_value": 3.0}, {"state": None, "source_key": "lbnl", "capacity_value": None}).withColumns({"county": F.lit(None).cast("string"), "cause_slugs": F.array(F.lit("a"), F.lit("b")), "verification_status": F.lit("verified")})
    X.export_csv(rows.coalesce(1), D.labels(spark, D.SOURCES), str(tmp_path / "csv"))
    lines = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv")).splitlines()
    assert lines[1] == '"say ""x""","generation","solar","TX","","3","MW","730","agency_permitting","a|b","verified","EIA-860M"'
    assert lines[2].split(",")[3] == '""' and lines[2].endswith('"LBNL Queued Up"')
    feed = X.build_feed(spark.createDataFrame([("u", "daily", 1.0)], "url string, change_frequency string, priority double"), spark.createDataFrame([("s", dt.datetime(2020, 1, 1))], "slug string, updated_at timestamp"), "http://b")
    assert sorted((r["url"], r["priority"]) for r in feed.collect()) == [("http://b/project/s", 0.7), ("u", 1.0)]
    stones = rows.withColumns({"application_filed_date": F.col("created_at"), "milestones": F.array(F.struct(F.col("created_at").alias("date")))})
    X.export_json(stones, str(tmp_path / "json"))
    assert '"date":"2020-01-01T00:00:00.000Z"' in "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))


def test_store_and_stream(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "state"))
    assert store.version() == 0 and store.read()["projects"].count() == 0
    assert store.apply(record(spark, {"slug": "a"}), day(1), batch=100) == 1
    assert store.apply(record(spark, {"slug": "zzz"}), day(2), batch=100) == 1
    landing, rows = str(tmp_path / "landing"), record(spark, {"slug": "b"}, {"slug": "c"})
    rows.coalesce(1).write.parquet(landing)
    run = lambda: incremental_ingest(spark, landing, rows.schema, lambda df: df, store, str(tmp_path / "ckpt"), day(3))
    assert run() == 2 and run() == 2
    record(spark, {"slug": "b", "current_stage": "completed"}).coalesce(1).write.mode("append").parquet(landing)
    assert run() == 3
    assert sorted(r["slug"] for r in store.read()["projects"].collect()) == ["a", "c"]
    dto_rows = R.serialize_projects(*[store.read()[t] for t in ("projects", "project_causes", "project_sources", "milestones")], F.lit(dt.datetime(2024, 2, 1)))
    assert R.get_project(dto_rows, "a").first()["sources"][0]["label"] == "l" and R.get_project(dto_rows, "nope").count() == 0


def test_one_writer_a_version(spark, tmp_path):
    """Of two runs that start from one version the second fails, and what the first wrote is read."""
    store = SnapshotStore(spark, str(tmp_path / "state"))
    assert store.apply(record(spark, {"slug": "a"}), day(1)) == 1
    store._current = lambda: (0, None)
    with pytest.raises(Exception, match="already exists|AlreadyExists"):
        store.apply(record(spark, {"slug": "b"}), day(2))
    again = SnapshotStore(spark, str(tmp_path / "state"))
    assert again.version() == 1 and [r["slug"] for r in again.read()["projects"].collect()] == ["a"]


def test_last_landed_wins(spark, tmp_path):
    """Two rows of one key in two files: that of the later file by name holds, and the header comes from the first."""
    folder = tmp_path / "edition"
    folder.mkdir()
    head = "FERC_docket,Project_name,Project_licensee,Waterway,Project_type,Latitude,Longitude,State,NOI_date,Application_date,Proc_type,Status,Capacity_new_MW"
    line = "P-1,Dam,,,,{},,WA,,2020-01-01,NA,Pending Relicense,300"
    (folder / "a.csv").write_text("\n".join([head, line.format(1), line.format(2)]) + "\n")
    (folder / "b.csv").write_text("\n".join([line.format(k) for k in (5, 4, 3)]) + "\n")
    store = SnapshotStore(spark, str(tmp_path / "state"))
    I.ingest(store, "ornlHydro", str(folder), day(1))
    assert [r["lat"] for r in store.read()["projects"].collect()] == [3.0]


def test_plans(spark, tmp_path):
    """Filters reach the scan, unread columns do not, and a page is a top-k."""
    dto(spark, {}, {}).write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(rows.where(FI.matches(FI.FilterState(min_capacity=250, fuel_types=("solar", "gas")))).select("id"))
    assert "PushedFilters: [" in text and "In(fuel_type" in text and "GreaterThanOrEqual(capacity_value" in text and "lat" not in text.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan(R.page(R.sort_projects(rows), 5, 5))
    assert "BatchEvalPython" not in plan(R.aggregate_stats(R.derive(rows.withColumn("application_filed_date", F.col("created_at")), F.lit(dt.datetime(2021, 1, 1)))))
