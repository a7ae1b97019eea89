"""A versioned snapshot of the state: four Parquet tables a version, and a pointer that is swapped last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import last_write_wins, replace_children, upsert
from .normalize import RECORD

PROJECTS = {"id": "string"} | RECORD | {"verification_status": "string", "created_at": "timestamp", "updated_at": "timestamp"}
CAUSES = {"project_id": "string", "cause_slug": "string"}
SOURCES = {"project_id": "string", "ordinal": "int", "label": "string", "url": "string"}
MILESTONES = {"project_id": "string", "date": "timestamp", "date_confidence": "string", "stage": "string", "description": "string"}
TABLES = {"projects": PROJECTS, "project_causes": CAUSES, "project_sources": SOURCES, "milestones": MILESTONES}

Tables = dict[str, DataFrame]


def empty_tables(spark: SparkSession) -> Tables:
    return {name: spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in cols.items())) for name, cols in TABLES.items()}


def next_state(tables: Tables, incoming: DataFrame, run_ts: Column, key: str = "slug", keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Tables:
    """The four tables after a run. ``incoming``: records with ``ordinal``; a later one with the same key wins.

    ``keep`` gets each table by its name, and what came in as ``incoming``, in the order in which they need each other,
    and returns it as it was kept (written and read again), so that nothing is computed twice."""
    rows = keep("incoming", last_write_wins(incoming, key))
    projects = keep("projects", upsert(tables["projects"], rows, run_ts, key))
    ids = projects.select(F.col("id").alias("project_id"), F.col(key).alias("_key"))
    live = rows.withColumnRenamed(key, "_key").join(ids, "_key")
    touched = live.select("project_id")
    causes = live.select("project_id", F.explode(F.array_distinct("cause_slugs")).alias("cause_slug"))
    sources = live.select("project_id", F.posexplode("sources").alias("ordinal", "s")).select("project_id", "ordinal", "s.label", "s.url")
    milestones = live.select("project_id", F.explode("milestones").alias("m")).select("project_id", "m.*")
    children = {
        "project_causes": replace_children(tables["project_causes"], causes, projects, touched),
        "project_sources": replace_children(tables["project_sources"], sources, projects, touched),
        "milestones": replace_children(tables["milestones"], milestones, projects, touched, only_if_new=True),
    }
    return {"projects": projects} | {name: keep(name, df) for name, df in children.items()}


class SnapshotStore:
    """``<root>/v=<n>-<id>/<table>`` for each version; the file of the largest number in ``<root>/pointer`` is the current one.

    A run writes all tables of a new version, each from what was written before, and adds the pointer's file last, so a
    reader or a failed run never sees half a version. A pointer's file is made only if it is not there: of two runs that
    start from one version the second fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        """The path and its file system, any that Spark knows."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> DataFrame | None:
        path, files = self._path("pointer")
        return self.spark.read.schema("version long, batch long, folder string").json(f"{self.root}/pointer") if files.exists(path) else None

    def _current(self) -> tuple[int, str | None]:
        pointer = self._pointer()
        row = None if pointer is None else pointer.agg(F.max(F.struct("version", "folder")).alias("p")).first()["p"]
        return (0, None) if row is None else (row["version"], row["folder"])

    def version(self) -> int:
        return self._current()[0]

    def has_batch(self, batch: int) -> bool:
        pointer = self._pointer()
        return pointer is not None and not pointer.where(F.col("batch") == batch).isEmpty()

    def read(self) -> Tables:
        """Tables of the current version; a column that is only kept, not served, is read when asked for."""
        folder = self._current()[1]
        if folder is None:
            return empty_tables(self.spark)
        return {t: self.spark.read.parquet(f"{self.root}/{folder}/{t}") for t in TABLES}

    def apply(self, incoming: DataFrame, run_ts: Column, batch: int | None = None, key: str = "slug") -> int:
        """Writes the next version; a batch that was applied before is skipped. Returns the current version."""
        if batch is not None and self.has_batch(batch):
            return self.version()
        n = self.version() + 1
        folder = f"v={n}-{uuid.uuid4().hex}"

        def keep(name: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{self.root}/{folder}/{name}")
            return self.spark.read.parquet(f"{self.root}/{folder}/{name}")

        next_state(self.read(), incoming, run_ts, key, keep)
        self._point(n, batch, folder)
        return n

    def _point(self, version: int, batch: int | None, folder: str) -> None:
        path, files = self._path(f"pointer/{version}.json")
        out = files.create(path, False)
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "folder": folder}).encode() + b"\n"))
        out.close()
