"""Readers of landed extracts, and discovery over landed tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.presets import SECTOR_TYPE

DASHBOARD_SCHEMA = T.StructType(
    [
        *[
            T.StructField(c, T.StringType())
            for c in (
                "project_id", "project_title", "project_field_project_lead_agency", "project_field_project_lead_agency_bureau", "project_category",
                "project_field_project_status", "project_sector", "project_sector_type", "project_field_location_state", "project_field_location_county",
                "project_lat", "project_lon", "total_estimated_project_cost",
            )
        ],
        T.StructField("project_url", T.StructType([T.StructField("url", T.StringType())])),
    ]
)


#: Where a landed row stands.
ORDINAL = "_ordinal"


def landed_at() -> Column:
    """Orders the rows of landed files: by file, then by place in it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def _text_columns(n: int) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(n)])


def read_sheet_export(spark: SparkSession, path: str, header_row: int) -> DataFrame:
    """A landed tab export (one or many files) as text columns under the names in line ``header_row``.

    The first lines of the first file by name that has any give the header; title, header and blank lines are recognised
    by what they hold, not by their number, so files may be split. Blank cells are null. All files must share the header.
    ``_ordinal`` tells where a row stands (file, block, line)."""
    head: list[str] = []
    for file in sorted(spark.read.text(path).inputFiles()):
        if head := [r[0] for r in spark.read.text(file).limit(header_row + 1).collect()]:
            break
    if len(head) <= header_row:
        raise ValueError(f"{path} has no line {header_row}")
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(head)], "i int, line string")
    width = max(len(x.split(",")) for x in head)
    cells = lines.select("i", F.from_csv("line", ", ".join(f"`_c{i}` string" for i in range(width)), {"escape": '"'}).alias("c")).orderBy("i").collect()
    names = [str(x) for x in cells[header_row]["c"] if x is not None]
    raw = spark.read.schema(_text_columns(len(names))).option("escape", '"').csv(path)
    blank = F.array(*[F.when(F.trim(c) != "", F.col(c)) for c in raw.columns])
    rows = raw.select(blank.alias("_cells"), landed_at().alias(ORDINAL))
    special = [[(x if x is not None and x.strip() else None) for x in list(c["c"])[: len(names)]] for c in cells]
    keep = F.exists("_cells", lambda x: x.isNotNull())
    for line in special:
        line = line + [None] * (len(names) - len(line))
        same = [F.col("_cells")[i].eqNullSafe(F.lit(v)) for i, v in enumerate(line)]
        all_same = same[0]
        for s in same[1:]:
            all_same = all_same & s
        keep = keep & ~all_same
    return rows.where(keep).select(*[F.col("_cells")[i].alias(n) for i, n in enumerate(names)], ORDINAL)


def resolve_columns(df: DataFrame, candidates: dict[str, list[str]], collapse_ws: bool = False) -> DataFrame:
    """A column per field, under the first header in sheet order that the field may have; all missing fields in one error."""
    tidy = (lambda h: re.sub(r"\s+", " ", h.strip())) if collapse_ws else str.strip
    headers = [(h, tidy(h)) for h in df.columns if h != ORDINAL]
    found, missing = {}, []
    for field, names in candidates.items():
        hit = next((raw for raw, h in headers if h in names), None)
        if hit is None:
            missing.append(f"{field} (one of: {', '.join(names)})")
        else:
            found[field] = hit
    if missing:
        raise ValueError(f"no header for {'; '.join(missing)}. Headers: {', '.join(h for _, h in headers)}")
    kept = [ORDINAL] if ORDINAL in df.columns else []
    return df.select(*[F.col("`" + raw.replace("`", "``") + "`").alias(f) for f, raw in found.items()], *kept)


def read_dashboard_json(spark: SparkSession, path: str, sectors: list[str] | None = None) -> DataFrame:
    """The dashboard's dataset, sectors of interest only; all rows, with ``_ordinal``."""
    rows = spark.read.schema(DASHBOARD_SCHEMA).json(path).select("*", landed_at().alias(ORDINAL))
    return rows.where(F.col("project_sector").isin(*(sectors or SECTOR_TYPE)))


def read_overrides(spark: SparkSession, path: str | None) -> DataFrame:
    """source, source_id, match_key and line; empty without a path or file. Blank lines and the header are dropped."""
    schema = "source string, source_id string, match_key string"
    empty = spark.createDataFrame([], f"{schema}, line long")
    if path is None:
        return empty
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return empty
    raw = spark.read.schema(schema).option("header", True).csv(path).withColumn("line", F.monotonically_increasing_id())
    trimmed = raw.select(*[F.trim(c).alias(c) for c in ("source", "source_id", "match_key")], "line")
    return trimmed.where("coalesce(source, '') <> '' and coalesce(source_id, '') <> '' and coalesce(match_key, '') <> ''")


def first_link(pages: DataFrame, html: str, base: str, pattern: str, out: str = "link") -> DataFrame:
    """Adds the first href that fits the pattern (case ignored), made absolute against the page's url; null without one."""
    # (?i) for the attribute and the pattern alike
    href = F.nullif(F.regexp_extract(html, f'(?i)href="({pattern})"', 1), F.lit(""))
    return pages.withColumn(out, resolve_url(href, F.col(base)))


def resolve_url(href: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.isNotNull(), F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    )


def latest_edition(probes: DataFrame, anchor: Column, n: int, unit: str = "month", prefixes: int = 2) -> DataFrame:
    """One row: the latest edition that really is there, walking back ``n`` months or years; raises if there is none.

    ``probes``: edition date, prefix_order, url, ok, content_type."""
    spark = probes.sparkSession
    step = F.expr(f"interval -1 {unit}")
    first = F.date_trunc(unit, anchor).cast("date")
    dates = F.sequence(first, F.date_trunc(unit, F.add_months(first, -(n - 1) * (12 if unit == "year" else 1))).cast("date"), step)
    walk = spark.range(1).select(F.posexplode(dates).alias("back", "edition")).select("*", F.explode(F.sequence(F.lit(0), F.lit(prefixes - 1))).alias("prefix_order"))
    real = probes.where(F.col("ok") & F.contains(F.lower("content_type"), F.lit("spreadsheet")))
    found = walk.join(real, ["edition", "prefix_order"])
    best = found.agg(F.min_by("url", F.struct("back", "prefix_order", "url")).alias("url"), F.min("back").alias("back"))
    if best.where("url is not null").isEmpty():
        raise ValueError(f"no edition among the last {n} {unit}s")
    return best
