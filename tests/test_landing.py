"""The sheet source, the dashboard by sector, ingestion in one pass with its quarantine, and pages by cursor."""

import datetime

import pytest
from pyspark.sql import functions as F

from wattline.functions import presets as P
from wattline.operators import readmodel as R
from wattline.plans.observed import ingest, land
from wattline.plans.snapshots import SnapshotStore
from wattline.sources.dashboard import land_by_sector, read_lines, scan_sectors
from wattline.sources.sheets import read_sheets, resolved, rows_of

FIELDS = {"a": ["A"], "b": ["B", "Bee"], "c": ["C one"]}


def test_rows_of_lines():
    lines = 'a,b\n"two\nlines",2\n"open,3\n4,5\n"x"y,6\n\n7,"8 ""quoted"" "\n"last open\n9,10'.splitlines(keepends=True)
    got = [(r.line, r.cells, r.fault is None) for r in rows_of(iter(lines))]
    assert got == [
        (1, ["a", "b"], True), (2, ["two\nlines", "2"], True), (4, None, False), (5, ["4", "5"], True), (6, None, False),
        (7, [], True), (8, ["7", '8 "quoted" '], True), (9, None, False), (10, ["9", "10"], True),
    ]


def test_unclosed_quotes_cost_one_line_each():
    lines = [f'"open {i}\n' if i % 300 == 0 else f"{i},x\n" for i in range(1, 2000)]
    rows = list(rows_of(iter(lines)))
    assert [r.line for r in rows] == list(range(1, 2000)) and sum(r.fault is not None for r in rows) == 6


def test_headers_are_resolved_in_sheet_order():
    assert resolved([" Bee ", "B", "C  one", "A"], FIELDS, True, "f") == {"a": 3, "b": 0, "c": 2}
    with pytest.raises(ValueError, match=r"a \(one of: A\).*c \(one of: C one\)"):
        resolved(["B", "C  one"], FIELDS, False, "f")


def test_sheet_source(spark, tmp_path):
    """Files with columns in different orders, cells of several lines, rows that equal the title, broken lines."""
    (tmp_path / "a.csv").write_bytes("﻿title,x\nA,B,C one\n1,\"two\nlines\",3\ntitle,x\n,,\n4,5,6,7\n4,5,6,\n".encode())
    (tmp_path / "b.csv").write_text('other\nC one,extra,Bee,A\n30,0,20,10\n"open,1\n31,0, ,11\nA,B,C one\n')
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "empty.csv").write_text("")
    fine, broken = read_sheets(spark, str(tmp_path), FIELDS, 1)
    assert sorted((r["_ordinal"]["file"][-5:], r["_ordinal"]["line"], r["a"], r["b"], r["c"]) for r in fine.collect()) == [
        ("a.csv", 3, "1", "two\nlines", "3"), ("a.csv", 5, "title", "x", None), ("a.csv", 8, "4", "5", "6"),
        ("b.csv", 3, "10", "20", "30"), ("b.csv", 5, "11", None, "31"), ("b.csv", 6, None, "C one", "A"),
    ]
    assert sorted((r["file"][-5:], r["line"], r["message"], r["text"]) for r in broken.collect()) == [("a.csv", 7, "more cells than headers", "4,5,6,7"), ("b.csv", 4, "a quote is not closed", '"open,1')]
    assert fine.rdd.getNumPartitions() == 2
    one, _ = read_sheets(spark, f"file://{tmp_path}/b.csv", FIELDS, 1)
    assert one.count() == 3
    with pytest.raises(Exception, match="no header for"):
        read_sheets(spark, str(tmp_path), FIELDS, 0)[0].count()


def test_land_in_one_pass(spark, tmp_path):
    """A pass counts what is skipped, written and wrong; its plan reads the source once."""
    heads = [h[-1] for h in P.HEADERS["ornlHydro"].values()]
    at = {f: i for i, f in enumerate(P.HEADERS["ornlHydro"])}

    def line(**cells):
        out = [""] * len(heads)
        for f, v in cells.items():
            out[at[f]] = v
        return ",".join(out)

    status, capacity = [next(f for f in at if f in names) for names in (("status",), ("capacity",))]
    docket = next(iter(at))
    rows = [line(**{docket: "P-1", status: "Pending Relicense", capacity: "300"}), line(**{docket: "P-2", status: "Issued", capacity: "300"}), line(**{docket: "P-3", status: "Pending Relicense", capacity: "3"}), '"broken']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.csv").write_text("\n".join([",".join(heads), *rows]))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    out = ingest(store, "ornlHydro", str(tmp_path / "in"), str(tmp_path / "out"), F.lit("2001-01-01").cast("timestamp"))
    assert out.summary.first().asDict() == {"upserted": 1, "removed_resolved": 0, "skipped_below_floor": 1, "skipped_not_waiting": 1, "skipped_not_active": 0, "skipped_already_cleared": 0, "errors": 1}
    assert store.read()["projects"].count() == 1
    kept = out.quarantine.collect()
    assert [(r["line"], r["message"], r["text"]) for r in kept] == [(5, "a quote is not closed", '"broken')] and kept[0]["file"].endswith("s.csv")


def dashboard(tmp_path, lines):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "rows.json").write_text("\n".join(lines))
    return str(tmp_path / "d")


def test_dashboard_lines(spark, tmp_path):
    path = dashboard(tmp_path, ['{"project_id": "1", "project_title": "Solar", "project_sector": "Pipelines"}', '{"project_id": "2", "proj', "", "[]", '{"project_id": "3", "project_sector": "Ports", "project_url": {"url": "u"}, "more": 1}'])
    fine, broken = read_lines(spark, path)
    assert sorted((r["project_id"], r["project_sector"]) for r in fine.collect()) == [("1", "Pipelines"), ("3", "Ports")]
    assert {r["text"] for r in broken.collect()} >= {'{"project_id": "2", "proj'}
    out = land(spark, "permittingDashboard", path, str(tmp_path / "out"))
    assert [r["source_id"] for r in out.records.collect()] == ["1"] and out.summary.first()["errors"] == broken.count()
    land_by_sector(fine, str(tmp_path / "sectors"))
    scan = scan_sectors(spark, str(tmp_path / "sectors"), ["Ports"])
    assert [(r["project_id"], r["project_url"]["url"]) for r in scan.collect()] == [("3", "u")]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project_sector" in plan or "PartitionFilters: [project_sector" in plan
    assert [r["project_id"] for r in scan_sectors(spark, str(tmp_path / "sectors")).collect()] == ["1"]


def test_pages_by_cursor(spark, tmp_path):
    """Walking all pages gives each row once, in each order, null keys and ties included; the scan carries the bound."""
    start = datetime.datetime(2001, 1, 1)
    rows = [(i, start + datetime.timedelta(days=i // 4), [None, "b", "B", "é", "a"][i % 5], [None, "TX", "", "NM"][i % 4], [None, 3, 5, 0][i % 4], [None, 2.5, 0.0, -1.0, 7.25][i % 5], [None, "Wind"][i % 2], [None, "s"][i % 2]) for i in range(37)]
    spark.createDataFrame(rows, "id long, created_at timestamp, name string, state string, days_waiting long, capacity_value double, fuel_label string, stage_label string").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    for key in ("name", "fuel", "state", "daysWaiting", "capacity", "stage"):
        for descending in (False, True):
            whole = [r["id"] for r in R.sort_projects(df, key, descending).collect()]
            walked, at = [], None
            while (page := [r["id"] for r in R.page_after(df, key, descending, at, 16).collect()]):
                walked += page
                at = R.cursor_of(df.where(F.col("id").isin(page)), key, descending)
            assert walked == whole, (key, descending)
    plan = R.page_after(df, "capacity", True, R.Cursor(2.5, start, 3), 5)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(capacity_value,2.5)" in plan and "TakeOrderedAndProject" in plan
    assert R.cursor_of(df.where("id < 0"), "name", True) is None
