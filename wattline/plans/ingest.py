"""Ingestion of the five sources: read, resolve, decide, normalise, upsert, summarise."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import presets as P
from ..functions.scalars import clean_cell, status_code, to_number
from ..operators.filters import below_floor, containing, disposition, status_in, status_is
from ..operators.state import dedupe_first, error_rows
from ..sources.readers import read_dashboard_json, read_overrides, read_sheet_export, resolve_columns
from . import normalize as N
from .snapshots import SnapshotStore


@dataclass
class Ingested:
    """Records that go on, rows that failed, and one row of counters."""

    records: DataFrame
    errors: DataFrame
    summary: DataFrame
    extra: dict = field(default_factory=dict)


def skip_reason(source: str, capacity: Column, status: Column, ia_phase: Column | None = None) -> Column:
    """Why a row is skipped, or 'keep'; the order of reasons differs by source."""
    low = ("below_floor", below_floor(to_number(capacity)))
    rules: dict[str, list[tuple[str, Column]]] = {
        "eia": [low, ("not_waiting", status_code(F.coalesce(status, F.lit(""))) == "")],
        "ornlHydro": [low, ("not_waiting", ~status_in(status, P.ORNL_WAITING))],
        "eiaPipelines": [("not_waiting", clean_cell(status).isNull())],
        "permittingDashboard": [],
    }
    if source == "lbnl":
        return disposition([("not_active", ~status_is(status, "active")), ("already_cleared", containing(ia_phase, P.LBNL_CLEARED)), low])
    return disposition(rules[source])


def dispositions(df: DataFrame, source: str) -> DataFrame:
    """Adds ``disposition``, the reason why a row is skipped."""
    column = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.withColumn("disposition", skip_reason(source, column("capacity"), column("status"), column("ia_phase")))


def ingest_summary(judged: DataFrame, records: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: rows by disposition, records that were upserted or removed, rows in error."""
    resolved = F.col("current_stage").isin(*P.RESOLVED_STAGES)
    skipped = judged.agg(*[F.count_if(F.col("disposition") == d).alias(f"skipped_{d}") for d in ("below_floor", "not_waiting", "not_active", "already_cleared")])
    done = records.agg(F.count_if(~resolved).alias("upserted"), F.count_if(resolved).alias("removed_resolved"))
    failed = errors.agg(F.count("*").alias("errors"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(done).join(one(skipped), "_one").join(one(failed), "_one").drop("_one")


def normalized(spark: SparkSession, source: str, path: str, overrides: str | None = None, centroids: DataFrame | None = None) -> Ingested:
    """The records of a landed edition."""
    named = read_overrides(spark, overrides) if overrides else None
    if source == "permittingDashboard":
        rows = dedupe_first(read_dashboard_json(spark, path), ["project_id"], ["project_title", F.to_json(F.struct("*").dropFields("_ordinal"))])
    else:
        sheet = read_sheet_export(spark, path, P.HEADER_ROW[source])
        rows = resolve_columns(sheet, P.HEADERS[source], collapse_ws=source == "eiaPipelines")
    judged = dispositions(rows, source)
    kept = judged.where("disposition = 'keep'").drop("disposition")
    make = {"eia": N.normalize_eia860m, "permittingDashboard": N.normalize_dashboard, "ornlHydro": N.normalize_ornl, "eiaPipelines": N.normalize_pipeline}
    if source == "lbnl":
        none = spark.createDataFrame([], "fips5 string, lat double, lon double")
        records = N.normalize_lbnl(kept, none if centroids is None else centroids, named)
    else:
        records = make[source](kept, named)
    fine, errors = error_rows(records, [("no name", F.col("name").isNotNull()), ("no key", F.col("source_id").isNotNull())])
    return Ingested(fine, errors, ingest_summary(judged, fine, errors))


def ingest(store: SnapshotStore, source: str, path: str, run_ts: Column, batch: int | None = None, **options) -> Ingested:
    """Normalises an edition and applies it to the store; of records with one key the one that landed last wins. One bad
    row does not stop the others."""
    out = normalized(store.spark, source, path, **options)
    store.apply(out.records, run_ts, batch)
    return out
