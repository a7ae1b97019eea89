"""Scalar functions of project records: Column to Column, no Python at run time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def days_waiting(filed: Column, as_of: Column) -> Column:
    """Whole days from a filing to a moment, never negative; null without a filing."""
    filed, as_of = filed.cast("timestamp"), as_of.cast("timestamp")
    days = F.floor((F.unix_millis(as_of) - F.unix_millis(filed)) / DAY_MS)
    return F.when(filed.isNotNull(), F.greatest(F.lit(0).cast("long"), days))


def years_waiting(filed: Column, as_of: Column) -> Column:
    return days_waiting(filed, as_of) / 365.25


def cost_per_kw(fuel: Column, costs: Mapping[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in costs.items() for x in (k, float(v))])
    return F.try_element_at(table, fuel)


def investment_waiting(fuel: Column, capacity: Column, unit: Column, costs: Mapping[str, float]) -> Column:
    """struct(applicable, reason, estimated_usd, cost_per_kw). The unit is looked at first, then the fuel, then the capacity."""
    cost = cost_per_kw(fuel, costs)
    reason = (
        F.when(~unit.eqNullSafe(F.lit("MW")), F.lit("Capacity is not in MW, so no estimate is made."))
        .when(cost.isNull(), F.concat(F.lit('No capital cost is known for fuel "'), F.coalesce(fuel, F.lit("")), F.lit('".')))
        .when(capacity.isNull(), F.lit("The capacity is missing."))
    )
    fine = unit.eqNullSafe(F.lit("MW")) & cost.isNotNull() & capacity.isNotNull()
    return F.struct(
        fine.alias("applicable"),
        reason.alias("reason"),
        F.when(fine, capacity * 1000 * cost).alias("estimated_usd"),
        F.when(fine, cost).alias("cost_per_kw"),
    )


def format_usd(x: Column) -> Column:
    return (
        F.when(x >= 1e9, F.format_string("$%.2fB", x / 1e9))
        .when(x >= 1e6, F.format_string("$%.1fM", x / 1e6))
        .when(x >= 1e3, F.format_string("$%.0fK", x / 1e3))
        .when(x.isNotNull(), F.format_string("$%.0f", x))
    )


def plain_number(x: Column) -> Column:
    """A double as text, whole ones without a fraction."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def format_capacity(value: Column, unit: Column) -> Column:
    number = F.when(value >= 100, F.format_number(F.floor(value + 0.5).cast("long"), 0)).otherwise(plain_number(value))
    return F.when(value.isNull(), F.lit("Not disclosed")).otherwise(F.trim(F.concat_ws(" ", number, F.coalesce(unit, F.lit("")))))


def clean_cell(col: Column) -> Column:
    """Trimmed; blank, "na" in any case and "-" are null."""
    text = F.trim(col)
    return F.when(~F.lower(text).isin("", "na", "-"), text)


def to_number(col: Column, strip_commas: bool = True) -> Column:
    """A finite double or null. Blank is null; separators of thousands are taken out."""
    text = F.trim(col.cast("string"))
    text = F.regexp_replace(text, ",", "") if strip_commas else text
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def excel_serial_to_ts(n: Column) -> Column:
    """Days since 1899-12-30, in Excel's count, to a timestamp."""
    ms = F.round((n - 25569) * DAY_MS)
    return F.when(F.abs(ms) < 1e15, F.timestamp_millis(ms.cast("long")))


def parse_date_cell(col: Column) -> Column:
    """A serial number or a date as text; blank, "NA" and what is neither are null."""
    text = F.trim(col.cast("string"))
    number = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))
    slashes = F.try_to_timestamp(text, F.lit("M/d/yyyy"))
    parsed = F.when(text.contains("/"), slashes).otherwise(F.try_to_timestamp(text))
    return F.when(text.isin("", "NA"), None).when(number.isNotNull(), excel_serial_to_ts(number)).otherwise(parsed).cast("timestamp")


def status_code(col: Column) -> Column:
    """The capitals in brackets that a status starts with, or ''."""
    return F.coalesce(F.regexp_extract(col, r"^\(([A-Z]+)\)", 1), F.lit(""))


def split_codes(col: Column) -> Column:
    """The entries of a list with commas, trimmed, without blanks; null gives []."""
    parts = F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def multi_state_centroid(col: Column, centroids: Column) -> Column:
    """[lon, lat]: the mean over the known codes of a list of two or more. ``centroids``: map from code to struct(lon, lat)."""
    codes = split_codes(col)
    points = F.filter(F.transform(codes, lambda c: F.try_element_at(centroids, c)), lambda p: p.isNotNull())
    n = F.size(points)

    def mean(field: str) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[field]) / n

    return F.when((F.size(codes) >= 2) & (n > 0), F.array(mean("lon"), mean("lat")))


def slugify(name: Column, key: Column) -> Column:
    """A readable, unique name of at most 90 characters: the key's last six, without signs, are never cut off."""
    suffix = F.regexp_replace(F.right(key, F.lit(6)), "[^A-Za-z0-9]", "")
    base = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    base = F.regexp_replace(base, "^-|-$", "")
    room = F.greatest(F.lit(89) - F.length(suffix), F.lit(1))
    return F.concat(F.substr(base, F.lit(1), room), F.lit("-"), suffix)


def marker_radius(value: Column, unit: Column) -> Column:
    scaled = F.greatest(F.lit(3.5), F.least(F.lit(12.0), F.sqrt(value) * 0.4))
    return F.when((unit == "MW") & value.isNotNull(), scaled).otherwise(F.lit(4.0))


def note_parts(*parts: Column) -> Column:
    """The parts that are there, as sentences of one note."""
    return F.concat_ws(" ", *parts)


def planned_operation(month: Column, year: Column) -> Column:
    month, year = F.trim(month), F.trim(year)
    return F.when((month != "") & (year != ""), F.concat_ws("/", month, year)).when(year != "", year).otherwise("unknown")


def waiting_label(years: Column) -> Column:
    return F.when(years.isNull(), F.lit("—")).otherwise(F.format_string("%.1f yrs", years))


def share_text(name: Column, years: Column) -> Column:
    return F.when(years.isNull(), F.concat(name, F.lit(" is waiting for approval."))).otherwise(
        F.concat(name, F.format_string(" has been waiting %.1f years for approval.", years))
    )


def join_list(col: Column) -> Column:
    return F.array_join(col, "|")


def encode_url(col: Column) -> Column:
    """Percent-encoded for a query, spaces as %20."""
    return F.replace(F.url_encode(col), F.lit("+"), F.lit("%20"))


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
