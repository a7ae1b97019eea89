"""A store whose runs cost what they change: tables in hash buckets, and a manifest that says which folder holds each.

``<root>/v=<n>-<id>/<table>/b=<bucket>`` holds the buckets that version n wrote; ``<root>/pointer/<n>.json`` is its
manifest: for each table the folder of each bucket, whichever version wrote it. A run reads and writes the buckets that an
incoming slug falls into, and points at the old folders for the rest. A manifest is added last and only if it is not there,
so a reader or a failed run never sees half a version, and of two runs from one version the second fails.

A project's id is the hash of its key, and buckets go by ids, so a project and its children are in one bucket, whichever
table they are in, and a run's joins stay inside its buckets. Each version also keeps

- ``changes``: the old and the new row of each project that the run touched (null for none), which other things follow;
- ``stats``: the statistics by fuel, type and stage, the former ones plus what the changes add (``operators/deltas.py``);
- ``state_index``: a table of (code, id), sorted by code in each bucket and with bloom filters, kept like the others.

A manifest has as many entries as tables times buckets; choose ``buckets`` so that one is a few hundred MB.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.presets import RESOLVED_STAGES
from ..functions.scalars import split_codes
from ..operators import deltas
from ..operators.state import changes, last_write_wins
from .snapshots import TABLES, SnapshotStore, Tables

STATE_INDEX = {"code": "string", "id": "string"}
BUCKETED = TABLES | {"state_index": STATE_INDEX}
#: The order of rows in a bucket's files, so that statistics of row groups tell where a value cannot be.
SORTED = {"projects": "slug", "project_causes": "project_id", "project_sources": "project_id", "milestones": "project_id", "state_index": "code"}
Manifest = dict


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def replaced(existing: DataFrame, incoming: DataFrame, touched: DataFrame) -> DataFrame:
    """The children of projects that were not touched (those have one row each there), and the incoming ones."""
    return existing.join(touched.select("project_id"), "project_id", "left_anti").unionByName(incoming)


class BucketStore(SnapshotStore):
    """Like ``SnapshotStore``, and of the same tables; ``key`` and ``buckets`` are fixed by the first version."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, key: str = "slug", rows_a_file: int = 1_000_000):
        super().__init__(spark, root)
        self.buckets, self.key, self.rows_a_file = buckets, key, rows_a_file

    # -------------------------------------------------------------- manifests

    def versions(self) -> DataFrame:
        """``version``, ``batch``, ``folder``, ``at`` (when it was pointed at, in seconds) of all versions that are kept."""
        path, files = self._path("pointer")
        schema = "version long, batch long, folder string, at double"
        return self.spark.read.schema(schema).json(f"{self.root}/pointer") if files.exists(path) else self.spark.createDataFrame([], schema)

    def manifest(self, version: int | None = None) -> Manifest:
        """Of a version, the current one if none is named."""
        n = self.version() if version is None else version
        if n == 0:
            return {"version": 0, "stats": None, "buckets": self.buckets, "key": self.key, "tables": {t: {} for t in BUCKETED}}
        path, files = self._path(f"pointer/{n}.json")
        if not files.exists(path):
            raise ValueError(f"there is no version {n}")
        out = json.loads(self.spark.read.text(f"{self.root}/pointer/{n}.json", wholetext=True).first()[0])
        if (out["buckets"], out["key"]) != (self.buckets, self.key):
            raise ValueError(f"the store has {out['buckets']} buckets by {out['key']}")
        return out

    def version_at(self, seconds: float) -> int:
        """The version that was current at a time; 0 before the first."""
        return self.versions().where(F.col("at") <= seconds).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    # -------------------------------------------------------------- reading

    def _table(self, manifest: Manifest, table: str, buckets: list[int] | None = None) -> DataFrame:
        held = manifest["tables"][table]
        paths = [f"{self.root}/{folder}/{table}/b={b}" for b, folder in held.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], ddl(BUCKETED[table]))
        return self.spark.read.schema(ddl(BUCKETED[table])).option("recursiveFileLookup", True).parquet(*paths)

    def read(self, version: int | None = None) -> Tables:
        """The tables of a version, the current one if none is named."""
        manifest = self.manifest(version)
        return {t: self._table(manifest, t) for t in TABLES}

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.sha2(key.cast("string"), 256)), F.lit(self.buckets)).cast("int")

    def get_project(self, slug: str, version: int | None = None) -> DataFrame:
        """Looked up in its bucket only. The store's key must be the slug."""
        bucket = self.spark.range(1).select(self.bucket_of(F.lit(slug))).first()[0]
        return self._table(self.manifest(version), "projects", [bucket]).where(F.col("slug") == slug)

    def with_state(self, code: str, version: int | None = None) -> DataFrame:
        """Projects whose list of states holds the code, found by the index: a scan of it for one code, and a semi-join."""
        manifest = self.manifest(version)
        found = self._table(manifest, "state_index").where(F.col("code") == code).select("id")
        return self._table(manifest, "projects").join(found, "id", "left_semi")

    def changes(self, version: int) -> DataFrame:
        """The key, ``old`` and ``new`` of all projects that the version touched."""
        return self.spark.read.parquet(f"{self.root}/{self._folder(version)}/changes")

    def stats(self, version: int | None = None) -> DataFrame:
        """The kept statistics by fuel, type and stage, for ``deltas.stats``."""
        folder = self.manifest(version)["stats"]
        empty = self.spark.createDataFrame([], ddl(deltas.CUBE))
        return empty if folder is None else self.spark.read.schema(ddl(deltas.CUBE)).parquet(f"{self.root}/{folder}/stats")

    def _folder(self, version: int) -> str:
        return self.manifest(version)["folder"]

    # -------------------------------------------------------------- writing

    def apply(self, incoming: DataFrame, run_ts: Column, batch: int | None = None, key: str | None = None) -> int:
        """Writes the next version; a batch that was applied before is skipped. Of rows with one key the one with the
        largest ``ordinal`` counts, rows without a key do not. Returns the current version."""
        if key not in (None, self.key):
            raise ValueError(f"the store's key is {self.key}")
        if batch is not None and self.has_batch(batch):
            return self.version()
        old = self.manifest()
        n = old["version"] + 1
        folder = f"v={n}-{uuid.uuid4().hex}"
        rows = last_write_wins(incoming.where(F.col(self.key).isNotNull()), self.key)
        rows = self._kept(folder, "incoming", rows.withColumn("_bucket", self.bucket_of(F.col(self.key))))
        # at most as many as there are buckets
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())
        have = {t: self._table(old, t, touched) for t in TABLES}
        feed = self._kept(folder, "changes", changes(have["projects"], rows, run_ts, self.key))
        kept = have["projects"].join(feed.select(self.key), self.key, "left_anti").select(*TABLES["projects"])
        out = {"projects": self._write(folder, "projects", kept.unionByName(feed.where("new is not null").select("new.*")), "id")}
        projects = self._read_back(folder, "projects", out["projects"])
        rows = rows.withColumn("project_id", F.sha2(F.col(self.key).cast("string"), 256))
        gone = F.coalesce(F.col("current_stage").isin(*RESOLVED_STAGES), F.lit(False))
        live = rows.where(~gone)
        causes = live.select("project_id", F.explode(F.array_distinct("cause_slugs")).alias("cause_slug"))
        sources = live.select("project_id", F.posexplode("sources").alias("ordinal", "s")).select("project_id", "ordinal", "s.label", "s.url")
        milestones = live.select("project_id", F.explode("milestones").alias("m")).select("project_id", "m.*")
        # a project of the old tables is not in this one only if it came in resolved, and live ones are in it, so children need
        # not be held against the projects; milestones stay if none came in
        children = {
            "project_causes": replaced(have["project_causes"], causes, rows),
            "project_sources": replaced(have["project_sources"], sources, rows),
            "milestones": replaced(have["milestones"], milestones, rows.where(gone | (F.size("milestones") > 0))),
        }
        out |= {t: self._write(folder, t, df, "project_id") for t, df in children.items()}
        index = projects.select(F.explode(F.array_distinct(split_codes(F.col("state")))).alias("code"), "id")
        out["state_index"] = self._write(folder, "state_index", index, "id")
        self._kept(folder, "stats", deltas.add(self.stats(n - 1), deltas.delta(feed)).coalesce(1))
        left = {t: {b: f for b, f in old["tables"][t].items() if int(b) not in touched} for t in BUCKETED}
        tables = {t: left[t] | {str(b): folder for b in out[t]} for t in BUCKETED}
        self._point(n, batch, folder, tables)
        return n

    def _kept(self, folder: str, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{folder}/{name}")
        return self.spark.read.parquet(f"{self.root}/{folder}/{name}")

    def _write(self, folder: str, table: str, df: DataFrame, id_col: str) -> list[int]:
        """Writes a table's rows by bucket; gives the buckets that have any."""
        path = f"{self.root}/{folder}/{table}"
        dealt = df.select(*BUCKETED[table], F.pmod(F.xxhash64(id_col), F.lit(self.buckets)).cast("int").alias("b")).repartition("b")
        writer = dealt.sortWithinPartitions("b", SORTED[table]).write.option("maxRecordsPerFile", self.rows_a_file).partitionBy("b")
        if table == "state_index":
            writer = writer.option("parquet.bloom.filter.enabled#code", "true").option("parquet.bloom.filter.expected.ndv#code", "1000")
        writer.parquet(path)
        at, files = self._path(f"{folder}/{table}")
        return sorted(int(s.getPath().getName()[2:]) for s in files.listStatus(at) if s.getPath().getName().startswith("b="))

    def _read_back(self, folder: str, table: str, buckets: list[int]) -> DataFrame:
        return self._table({"tables": {table: {str(b): folder for b in buckets}}}, table)

    def _point(self, version: int, batch: int | None, folder: str, tables: dict[str, dict[str, str]] | None = None) -> None:
        path, files = self._path(f"pointer/{version}.json")
        manifest = {"version": version, "batch": batch, "folder": folder, "at": time.time(), "buckets": self.buckets, "key": self.key, "stats": folder, "tables": tables}
        out = files.create(path, False)
        out.write(bytearray(json.dumps(manifest).encode() + b"\n"))
        out.close()

    # -------------------------------------------------------------- clearing

    def clear(self, keep: int = 2, older_s: float = 7 * 86400) -> list[str]:
        """Removes versions but the last ``keep``, and every folder that no version that is left names (of failed runs, and
        whose buckets were all written again). A folder younger than ``older_s`` seconds is left, as a run may be writing
        it. Gives the names of the folders that went.

        The manifest of an old version goes before its folders, so no reader finds one whose folders are gone."""
        kept = [r["version"] for r in self.versions().select("version").collect()]
        last = sorted(kept)[-keep:]
        named: dict[str, int] = defaultdict(int)
        for manifest in map(self.manifest, last):
            for folder in {manifest["folder"], manifest["stats"], *(f for t in manifest["tables"].values() for f in t.values())}:
                named[folder] += 1
        for n in set(kept) - set(last):
            path, files = self._path(f"pointer/{n}.json")
            files.delete(path, False)
        root, files = self._path("")
        gone, now = [], time.time()
        for s in files.listStatus(root) if files.exists(root) else []:
            name = s.getPath().getName()
            if name.startswith("v=") and name not in named and now - s.getModificationTime() / 1000 >= older_s:
                files.delete(s.getPath(), True)
                gone.append(name)
        return sorted(gone)
