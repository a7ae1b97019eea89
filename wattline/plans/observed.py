"""Ingestion in one pass over the source: rows are counted while the records are written, broken lines are kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import presets as P
from ..operators.state import dedupe_first
from ..sources.dashboard import read_lines
from ..sources.readers import read_overrides
from ..sources.sheets import read_sheets
from . import normalize as N
from .ingest import dispositions
from .snapshots import SnapshotStore

SKIPPED = ("below_floor", "not_waiting", "not_active", "already_cleared")
QUARANTINE = "file string, line long, message string, text string"


@dataclass
class Landed:
    """What a pass wrote: records, rows in error (with place, message and text), and one row of counters."""

    records: DataFrame
    quarantine: DataFrame
    summary: DataFrame


def land(spark: SparkSession, source: str, path: str, folder: str, overrides: str | None = None, centroids: DataFrame | None = None) -> Landed:
    """Reads, decides, normalises, checks and writes an edition to ``folder``; lines that cannot be read and records without
    a name or key go to its quarantine, the others go on.

    One job scans the source's rows: the skipped ones are counted where they are decided, the rest where they are written.
    A second one keeps the broken lines, which are few. Overrides and centroids are joined by the size Spark sees; while they
    are broadcast all counting is in the stage that writes, whose tasks count once however often they run."""
    named = read_overrides(spark, overrides) if overrides else None
    if source == "permittingDashboard":
        rows, broken = read_lines(spark, path)
        rows = rows.where(F.col("project_sector").isin(*P.SECTOR_TYPE))
        rows = dedupe_first(rows, ["project_id"], ["project_title", F.to_json(F.struct("*").dropFields("_ordinal"))])
    else:
        rows, broken = read_sheets(spark, path, P.HEADERS[source], P.HEADER_ROW[source], source == "eiaPipelines")
    seen, done = Observation(), Observation()
    judged = dispositions(rows, source).observe(seen, *[F.count_if(F.col("disposition") == d).alias(f"skipped_{d}") for d in SKIPPED])
    kept = judged.where("disposition = 'keep'").drop("disposition")
    make = {"eia": N.normalize_eia860m, "permittingDashboard": N.normalize_dashboard, "ornlHydro": N.normalize_ornl, "eiaPipelines": N.normalize_pipeline}
    if source == "lbnl":
        none = spark.createDataFrame([], "fips5 string, lat double, lon double")
        records = N.normalize_lbnl(kept, none if centroids is None else centroids, named)
    else:
        records = make[source](kept, named)
    fault = F.when(F.col("name").isNull(), "no name").when(F.col("source_id").isNull(), "no key")
    resolved, fine = F.col("current_stage").isin(*P.RESOLVED_STAGES), F.col("_message").isNull()
    marked = records.withColumn("_message", fault).observe(
        done, F.count_if(fine & ~resolved).alias("upserted"), F.count_if(fine & resolved).alias("removed_resolved"), F.count_if(~fine).alias("errors")
    )
    marked.write.parquet(f"{folder}/records")
    back = spark.read.parquet(f"{folder}/records")
    bad = back.where("_message is not null").select("ordinal.file", "ordinal.line", F.col("_message").alias("message"), F.col("match_key").alias("text"))
    unread = Observation()
    broken.observe(unread, F.count("*").alias("n")).unionByName(bad).write.parquet(f"{folder}/quarantine")
    counts = done.get | seen.get
    counts["errors"] += unread.get["n"]
    names = ["upserted", "removed_resolved", *[f"skipped_{d}" for d in SKIPPED], "errors"]
    summary = spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names))
    return Landed(back.where("_message is null").drop("_message"), spark.read.schema(QUARANTINE).parquet(f"{folder}/quarantine"), summary)


def ingest(store: SnapshotStore, source: str, path: str, folder: str, run_ts: Column, batch: int | None = None, **options) -> Landed:
    """Lands an edition and applies its records to the store."""
    out = land(store.spark, source, path, folder, **options)
    store.apply(out.records, run_ts, batch)
    return out
