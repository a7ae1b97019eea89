"""Scalar functions and rules, case by case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattline.functions import presets as P
from wattline.functions import scalars as S
from wattline.functions.classify import code_map_with_override, contains_rules, exact_map, first_match


def apply(spark, expr, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in rows.select("i", expr(F.col("x"))).orderBy("i").collect()]


AS_OF = dt.datetime(2024, 1, 10)


def test_days_and_years(spark):
    filed = [None, dt.datetime(2030, 1, 1), dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 9, 0, 0, 0, 1000), dt.datetime(2023, 1, 10)]
    as_of = F.lit(AS_OF)
    assert apply(spark, lambda c: S.days_waiting(c, as_of), filed, "timestamp") == [None, 0, 1, 0, 365]
    years = apply(spark, lambda c: S.years_waiting(c, as_of), filed, "timestamp")
    assert years[0] is None and years[4] == pytest.approx(365 / 365.25)


@pytest.mark.parametrize(
    "fuel,capacity,unit,applicable,usd,reason",
    [("solar", 10.0, "MW", True, 10 * 1000 * 1327, None), ("solar", None, "MW", False, None, "capacity"), ("lng", 5.0, "MW", False, None, "lng"), ("lng", None, "MTPA", False, None, "MW"), (None, 1.0, None, False, None, "MW"), (None, 1.0, "MW", False, None, "capital")],
)
def test_investment(spark, fuel, capacity, unit, applicable, usd, reason):
    row = spark.createDataFrame([(fuel, capacity, unit)], "f string, c double, u string")
    got = row.select(S.investment_waiting(F.col("f"), F.col("c"), F.col("u"), P.COST_PER_KW).alias("i")).first()["i"]
    assert got["applicable"] == applicable and got["estimated_usd"] == usd
    assert (got["reason"] is None) == (reason is None) and (reason is None or reason in got["reason"])


def test_formats(spark):
    assert apply(spark, S.format_usd, [2.5e9, 1.25e6, 1500.4, 12.0, None], "double") == ["$2.50B", "$1.3M", "$2K", "$12", None]
    both = spark.createDataFrame([(0, None, "MW"), (1, 1234.5, "MW"), (2, 99.5, "MW"), (3, 100.0, None), (4, 12.0, "MMcf/d")], "i int, v double, u string")
    got = [r[0] for r in both.orderBy("i").select(S.format_capacity(F.col("v"), F.col("u"))).collect()]
    assert got == ["Not disclosed", "1,235 MW", "99.5 MW", "100", "12 MMcf/d"]
    assert apply(spark, S.waiting_label, [None, 2.34], "double") == ["—", "2.3 yrs"]
    assert apply(spark, S.encode_url, ["a b+c", "é"]) == ["a%20b%2Bc", "%C3%A9"]


def test_cells(spark):
    cells = [" NA ", "na", "-", "", None, " x ", "1,200.0", "0", "NaN", "Infinity", "1d", "12e2"]
    assert apply(spark, S.clean_cell, cells) == [None] * 5 + ["x", "1,200.0", "0", "NaN", "Infinity", "1d", "12e2"]
    assert apply(spark, S.to_number, cells) == [None] * 6 + [1200.0, 0.0, None, None, None, 1200.0]
    assert apply(spark, S.blank_to_null, ["", " ", "a", None]) == [None, None, "a", None]


def test_dates(spark):
    got = apply(spark, S.parse_date_cell, ["43511", "43511.5", "2020-01-05", "NA", "", None, "no date", "1/5/2020"])
    assert got == [dt.datetime(2019, 2, 15), dt.datetime(2019, 2, 15, 12), dt.datetime(2020, 1, 5), None, None, None, None, dt.datetime(2020, 1, 5)]
    assert apply(spark, S.iso_ms, [dt.datetime(2020, 1, 5, 1, 2, 3, 456000)], "timestamp") == ["2020-01-05T01:02:03.456Z"]


def test_codes_and_slugs(spark):
    assert apply(spark, S.status_code, ["(TS) x", "(P) y", "none", "(p) z", None]) == ["TS", "P", "", "", ""]
    assert apply(spark, S.split_codes, ["NY,CT, MA ,,RI", "", None, "TX, MX"]) == [["NY", "CT", "MA", "RI"], [], [], ["TX", "MX"]]
    pairs = spark.createDataFrame([("Big -- Solar (Unit 1)", "eia:12-AB_c"), ("x" * 200, "k:1234567"), ("-", "ab")], "n string, k string")
    got = [r[0] for r in pairs.select(S.slugify(F.col("n"), F.col("k"))).collect()]
    assert got == ["big-solar-unit-1-2ABc", "x" * 83 + "-234567", "-ab"]
    assert all(len(s) <= 90 for s in got)


def test_first_match(spark):
    titles = ["LNG terminal", "liquefaction plant", "Solar and storage", "offshore wind", "Upwind ranch", "wind farm", "Amsterdam", "SMR", "gas transmission", "kV line", "éwind", "windé", None]
    got = apply(spark, lambda c: first_match(c, P.DASHBOARD_TITLE_FUEL, "other"), titles)
    assert got == ["lng", "other", "solar", "wind_offshore", "other", "wind_onshore", "hydro", "nuclear", "pipeline", "transmission", "wind_onshore", "wind_onshore", "other"]
    assert apply(spark, lambda c: first_match(c, P.LBNL_RESOURCE_FUEL, "other"), ["Solar+Battery", "Offshore Wind", "Coal", "Gas", "Biogas"]) == ["solar", "wind_offshore", "other", "gas", "other"]


def test_maps(spark):
    assert apply(spark, lambda c: exact_map(c, P.EIA_STAGE, "d"), ["P", "V", "ZZ", None]) == ["planned_pre_filing", "under_construction", "d", "d"]
    assert apply(spark, lambda c: contains_rules(c, P.DASHBOARD_STAGE, "d"), ["Complete", "Withdrawn", "Under Construction", "Paused", None]) == ["completed", "cancelled", "under_construction", "d", "d"]
    rows = spark.createDataFrame([("WND", "Offshore Wind Turbine"), ("NG", "Batteries"), ("NG", "Battery"), ("XX", "x"), ("SUN", "x")], "c string, t string")
    got = [r[0] for r in rows.select(code_map_with_override(F.col("c"), F.col("t"), P.EIA_TECHNOLOGY_FUEL, P.EIA_FUEL, "other")).collect()]
    assert got == ["wind_offshore", "gas", "storage", "other", "solar"]


def test_centroid_and_radius(spark):
    from wattline.sources import dims as D

    at = apply(spark, lambda c: S.multi_state_centroid(c, D.centroid_map()), ["TX, MX", "TX", "ZZ,YY", "NY,CT,NY", None])
    assert at[1] is None and at[2] is None and at[4] is None and at[0] == [-99.9018, 31.9686]
    assert at[3][0] == pytest.approx((-74.9481 * 2 - 72.7554) / 3)
    rows = spark.createDataFrame([(v, u) for v, u in [(0.0, "MW"), (76.0, "MW"), (77.0, "MW"), (900.0, "MW"), (901.0, "MW"), (None, "MW"), (5000.0, "MMcf/d")]], "v double, u string")
    got = [r[0] for r in rows.select(S.marker_radius(F.col("v"), F.col("u"))).collect()]
    assert got[0] == got[1] == 3.5 and 3.5 < got[2] < 3.52 and got[3] == got[4] == 12.0 and got[5] == got[6] == 4.0


def test_literals_guard_patterns(spark):
    """A pattern's literals stand in all that it is found in, so that guarded rules give what plain ones do."""
    from wattline.functions.classify import first_match, literals

    assert literals(r"\bLNG\b|liquefi(ed|action)") == ["lng", "liquefi"] and literals("colou?r|ab*") is None and literals("a|bc") is None and literals(r"\d+x") is None
    texts = ["LNG here", "a liquefied gas", "Liquefaction", "Amsterdam", "Solar and storage", "PV", "pvc", "SMR", "offshore WIND", "upwind", "345 kV line", "nothing", "\u212aV", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for rules in (P.DASHBOARD_TITLE_FUEL, P.LBNL_RESOURCE_FUEL, P.SOURCE_LABEL_KEY):
        rows = frame.select(first_match(F.col("t"), rules, "other").alias("a"), first_match(F.col("t"), rules, "other", F.lower("t")).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows)
