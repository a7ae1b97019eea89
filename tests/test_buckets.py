"""The store in buckets, its change feed, statistics, index, past versions and clearing; the stateful stream."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from wattline.functions.presets import RESOLVED_STAGES
from wattline.operators import deltas
from wattline.operators.filters import FilterState
from wattline.operators.readmodel import derive, filtered_stats
from wattline.operators.state import default_fields
from wattline.plans.buckets import BucketStore
from wattline.plans.normalize import CHILDREN, RECORD
from wattline.plans.snapshots import TABLES, SnapshotStore
from wattline.streaming.stateful import from_writes, stateful_ingest

DAY = "2001-01-0{}"
RAW = "slug string, current_stage string, capacity_value double, capacity_unit string, fuel_type string, state string, is_aggregate_example boolean, cause_slugs array<string>, sources array<struct<label:string,url:string>>, milestones array<struct<date:timestamp,date_confidence:string,stage:string,description:string>>, ordinal long"


def record(slug, ordinal, stage="agency_permitting", mw=100.0, unit="MW", fuel="solar", state="TX, OK", aggregate=False, stones=()):
    stones = [(None, "exact", s, f"{slug} {s}") for s in stones]
    return (slug, stage, mw, unit, fuel, state, aggregate, ["a", "a", f"c-{slug}"], [("first", f"u-{slug}-{ordinal}"), ("second", "v")], stones, ordinal)


def records(spark, rows):
    df = spark.createDataFrame(rows, RAW).withColumns({"name": F.concat(F.lit("n "), "slug"), "project_type": F.lit("generation")})
    return default_fields(df, RECORD | CHILDREN | {"ordinal": "long"})


def run(store, spark, rows, day):
    return store.apply(records(spark, rows), F.lit(DAY.format(day)).cast("timestamp"))


RUNS = [
    [record(f"p{i}", i, stones=("x", "y") if i % 2 else (), mw=i * 10.25, state=["TX", "TX, OK", None, "OK,OK, ", "tx"][i % 5], aggregate=i % 11 == 0) for i in range(60)],
    [record("p1", 1, mw=None), record("p2", 1, stage=RESOLVED_STAGES[0]), record("p2", 0), record("unknown", 1, stage=RESOLVED_STAGES[1]), record("new", 5, stones=("z",), fuel="gas"), record("new", 4)],
    [record("p2", 1, unit="MMcf/d"), record("p3", 2, stones=("later",), state="NM"), record(None, 3)],
    [record(f"p{i}", 9, stage=RESOLVED_STAGES[2]) for i in range(60)],
]


def everything(tables):
    """All rows of the four tables, maps as text."""
    out = {}
    for name, df in tables.items():
        shown = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() == "map" else F.col(c) for c in TABLES[name]]
        out[name] = sorted(map(str, df.select(*shown).collect()))
    return out


def test_buckets_like_a_whole_rewrite(spark, tmp_path):
    """After each run the tables are those of the store that rewrites all, past versions stay as they were, the kept
    statistics equal those counted in full, and the index finds what a scan does."""
    buckets, whole = BucketStore(spark, str(tmp_path / "b"), 4), SnapshotStore(spark, str(tmp_path / "w"))
    seen = {0: everything(buckets.read())}
    for day, rows in enumerate(RUNS, 1):
        assert run(buckets, spark, rows, day) == day
        run(whole, spark, [r for r in rows if r[0] is not None], day)
        seen[day] = everything(buckets.read())
        assert seen[day] == everything(whole.read())
        if day == 1:
            continue
        projects = buckets.read()["projects"]
        for chosen in (FilterState(), FilterState(fuel_types=("gas",), stages=("agency_permitting",))):
            full = filtered_stats(derive(projects, F.lit("2002-01-01").cast("timestamp")).withColumn("source_key", F.lit("eia")), chosen).first().asDict()
            assert deltas.stats(buckets.stats(), chosen).first().asDict() == pytest.approx(full)
        assert sorted(map(str, buckets.stats().collect())) == sorted(map(str, deltas.cube(projects).collect()))
        held = projects.select("slug", "state").collect()
        for code in ("OK", "tx", ""):
            scan = [r["slug"] for r in held if code and code in map(str.strip, (r["state"] or "").split(","))]
            assert sorted(r["slug"] for r in buckets.with_state(code).collect()) == sorted(scan)
        assert [r["slug"] for r in buckets.get_project("p7").collect()] == ([] if day == 4 else ["p7"])
    for day in (1, 3):
        assert everything(buckets.read(day)) == seen[day]
    feed = {r["slug"]: (r["old"] is not None, r["new"] is not None) for r in buckets.changes(2).collect()}
    assert feed == {"p1": (True, True), "p2": (True, False), "new": (False, True)}


def test_untouched_buckets_keep_their_folders(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), 16)
    run(store, spark, [record(f"p{i}", i) for i in range(300)], 1)
    before = store.manifest()["tables"]
    some = {r["b"] for r in spark.createDataFrame([("p1",), ("p2",), ("p3",)], "s string").select(store.bucket_of(F.col("s")).alias("b")).collect()}
    files = {p: os.stat(p).st_mtime_ns for p in map(str, tmp_path.rglob("*.parquet"))}
    run(store, spark, [record(f"p{i}", 7, mw=1.0) for i in (1, 2, 3)], 2)
    after = store.manifest()["tables"]
    for table, held in before.items():
        moved = {int(b) for b in held if after[table].get(b) != held[b]}
        assert moved == {b for b in some if str(b) in held}
    assert len(some) < 16 and all(os.stat(p).st_mtime_ns == t for p, t in files.items())


def test_store_faults(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), 4)
    run(store, spark, [record("a", 1)], 1)
    with pytest.raises(ValueError, match="buckets"):
        BucketStore(spark, str(tmp_path), 8).read()
    with pytest.raises(ValueError, match="version"):
        store.read(9)
    with pytest.raises(ValueError, match="filtered by"):
        deltas.stats(store.stats(), FilterState(min_years=1))
    with pytest.raises(Exception, match="(?i)exist"):  # two runs from one version
        store._point(1, None, "v=1-other", {})
    assert store.apply(records(spark, [record("b", 1)]), F.lit("2001-01-02").cast("timestamp"), batch=7) == 2
    assert store.apply(records(spark, [record("c", 1)]), F.lit("2001-01-03").cast("timestamp"), batch=7) == 2


def test_clear(spark, tmp_path):
    """Folders of failed runs and old versions go, the ones that live versions name stay, and so does what is young."""
    store = BucketStore(spark, str(tmp_path), 4)
    run(store, spark, [record(f"p{i}", i) for i in range(40)], 1)
    run(store, spark, [record("p1", 1, mw=5.0)], 2)
    run(store, spark, [record(f"p{i}", i, mw=6.0) for i in range(40)], 3)
    failed = tmp_path / "v=4-failed" / "projects"
    failed.mkdir(parents=True)
    now = everything(store.read())
    assert store.clear(keep=2) == []  # all are younger than a week
    assert store.version() == 3 and everything(store.read()) == now
    first, second = store.manifest(2)["tables"]["projects"], store.manifest(2)["folder"]
    gone = store.clear(keep=1, older_s=0)
    assert "v=4-failed" in gone and second in gone and set(first.values()) <= set(gone)
    assert store.version() == 3 and everything(store.read()) == now
    assert store.clear(keep=1, older_s=0) == []
    with pytest.raises(ValueError):
        store.read(2)
    assert run(store, spark, [record("after", 1)], 4) == 4


def test_version_at(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), 4)
    assert store.version_at(1e12) == 0
    run(store, spark, [record("a", 1)], 1)
    at = store.versions().first()["at"]
    assert (store.version_at(at), store.version_at(at - 1)) == (1, 0)


def test_index_plan(spark, tmp_path):
    """A lookup scans the index for one code, and joins by it."""
    store = BucketStore(spark, str(tmp_path), 4)
    run(store, spark, RUNS[0], 1)
    plan = store.with_state("TX")._jdf.queryExecution().toString()
    assert "EqualTo(code,TX)" in plan and "LeftSemi" in plan


# ------------------------------------------------------------------ stateful ingestion

LANDED = "slug string, stage string, mw double, edition long"


def land(spark, folder, rows):
    spark.createDataFrame(rows, LANDED).coalesce(1).write.mode("append").parquet(folder)


def landed_records(df):
    rows = df.select("slug", F.col("stage").alias("current_stage"), F.col("mw").alias("capacity_value"), F.lit("MW").alias("capacity_unit"), F.lit("solar").alias("fuel_type"), F.lit("generation").alias("project_type"), "edition")
    rows = rows.withColumns({"application_filed_date": F.lit("1999-05-05 01:02:03.456789").cast("timestamp"), "sources": F.array(F.struct(F.lit("l").alias("label"), F.lit('u"1').alias("url"))), "external_ids": F.create_map(F.lit("eia"), F.col("slug"))})
    return default_fields(rows, RECORD | CHILDREN | {"edition": "long"})


class Counting(BucketStore):
    given = None

    def apply(self, incoming, run_ts, batch=None, key=None):
        self.given.append(sorted((r["slug"], r["capacity_value"]) for r in incoming.collect()))
        return super().apply(incoming, run_ts, batch, key)


def test_stateful_ingest(spark, tmp_path):
    root, store = str(tmp_path / "landing"), Counting(spark, str(tmp_path / "state"), 4)
    store.given = []

    def go(day, checkpoint="stream", **more):
        return stateful_ingest(spark, root, LANDED, landed_records, store, str(tmp_path / checkpoint), F.lit(DAY.format(day)).cast("timestamp"), F.col("edition"), **more)

    land(spark, root, [("a", "agency_permitting", 1.0, 10), ("b", "agency_permitting", 2.0, 10), ("a", "agency_permitting", 9.0, 9), (None, "agency_permitting", 3.0, 10), ("c", "agency_permitting", 4.0, None)])
    assert go(1) == 1 and store.given == [[("a", 1.0), ("b", 2.0)]]
    assert go(1) == 1 and len(store.given) == 1  # nothing new
    land(spark, root, [("a", "agency_permitting", 1.0, 20), ("b", "agency_permitting", 7.0, 5), ("d", "agency_permitting", 5.0, 20)])
    assert go(2) == 2 and store.given[1:] == [[("d", 5.0)]]  # a repeat and a late write go no further
    land(spark, root, [("a", "agency_permitting", 8.0, 15), ("b", RESOLVED_STAGES[0], 2.0, 30), ("d", "agency_permitting", 6.0, 21)])
    assert go(3) == 3 and store.given[2:] == [[("b", 2.0), ("d", 6.0)]]  # older than the repeat
    stored = {r["slug"]: r for r in store.read()["projects"].collect()}
    assert {s: r["capacity_value"] for s, r in stored.items()} == {"a": 1.0, "d": 6.0}
    assert str(stored["a"]["application_filed_date"]) == "1999-05-05 01:02:03.456789" and stored["a"]["external_ids"] == {"eia": "a"}
    assert store.read()["project_sources"].where("url = 'u\"1'").count() == 2


def test_stateful_ingest_again_after_a_failure(spark, tmp_path):
    """A batch that failed after the store had it comes again from the checkpoint and is applied once; state and files go on
    together."""
    root, store = str(tmp_path / "landing"), BucketStore(spark, str(tmp_path / "state"), 4)

    class Failing(BucketStore):
        def apply(self, *args, **more):
            super().apply(*args, **more)
            raise RuntimeError("lost")

    def go(which):
        return stateful_ingest(spark, root, LANDED, landed_records, which, str(tmp_path / "stream"), F.lit(DAY.format(1)).cast("timestamp"), F.col("edition"), expiry_ms=10**9)

    land(spark, root, [("a", "agency_permitting", 1.0, 10)])
    with pytest.raises(Exception, match="lost"):
        go(Failing(spark, str(tmp_path / "state"), 4))
    assert store.version() == 1
    assert go(store) == 1
    land(spark, root, [("a", "agency_permitting", 1.0, 11), ("b", "agency_permitting", 2.0, 11)])
    assert go(store) == 2
    assert sorted(r["slug"] for r in store.changes(2).collect()) == ["b"]
    shutil.rmtree(root)


def test_writes_round_trip(spark):
    df = spark.createDataFrame([("s", 'q"\n', float("inf"), 3)], "slug string, stage string, mw double, edition long")
    from wattline.streaming.stateful import as_writes

    before = landed_records(df)
    after = from_writes(as_writes(before, "slug", F.col("edition")))
    shown = lambda d: [str(r.asDict(True)) for r in d.select(*RECORD, *CHILDREN).collect()]
    assert shown(after) == shown(before) and after.first()["ordinal"] == 3


class Kept:
    """A value state that counts how often it is asked."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema, expiry_ms=None):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def getCurrentProcessingTimeInMs(self):
        return self.now


@pytest.mark.parametrize("expiry", (None, 25))
def test_state_in_groups_of_keys(expiry):
    """What goes on is what goes on key by key, and the state is asked twice for a group at most, however many keys it has."""
    import random

    import pandas as pd

    from wattline.streaming.stateful import LastWrite

    draw, state, known = random.Random(7), Kept(), {}
    op = LastWrite(expiry)
    op.init(state)
    for batch in range(12):
        state.now, state.calls = 1000 + batch * 10, 0
        rows = [(draw.randrange(3), draw.randrange(-40, 40), draw.randrange(-3, 4), draw.randrange(-2, 3)) for _ in range(draw.choice((1, 50, 400)))]
        best, want = {}, []
        for k1, k2, written, digest in rows:
            best[k1, k2] = max(best.get((k1, k2), (written, digest)), (written, digest))
        for k, new in best.items():
            old = known.get(k)
            if old is not None and expiry and old[1] + expiry <= state.now:
                old = None
            if old is None or new > old[0]:
                known[k] = (new, state.now)
                if old is None or new[1] != old[0][1]:
                    want.append((new[0], f"{k} {new[1]}"))
        df = pd.DataFrame([(*r, f"{r[:2]} {r[3]}") for r in rows], columns=["k1", "k2", "written", "digest", "record"])
        parts = [df.iloc[i : i + 30] for i in range(0, len(df), 30)]
        got = [tuple(r) for out in op.handleInputRows((0,), iter(parts), state) for r in out.itertuples(index=False)]
        assert sorted(got) == sorted(want) and state.calls <= 2


def test_state_partitions_of_a_call(spark, tmp_path):
    """A call may say how many state stores there are; the session's own setting stays."""
    root, store, was = str(tmp_path / "landing"), BucketStore(spark, str(tmp_path / "state"), 4), spark.conf.get("spark.sql.shuffle.partitions")
    land(spark, root, [(f"p{i}", "agency_permitting", 1.0, 10) for i in range(50)])
    at = str(tmp_path / "stream")
    assert stateful_ingest(spark, root, LANDED, landed_records, store, at, F.lit(DAY.format(1)).cast("timestamp"), F.col("edition"), groups=8, partitions=2) == 1
    assert store.read()["projects"].count() == 50 and spark.conf.get("spark.sql.shuffle.partitions") == was
    assert sorted(p for p in os.listdir(f"{at}/state/0") if p.isdigit()) == ["0", "1"] and not os.path.exists(f"{at}/writes")
