"""Incremental ingestion that remembers, in the stream's own state, what it has applied to each project."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.normalize import CHILDREN, RECORD
from ..plans.snapshots import SnapshotStore

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"
#: What is remembered of a key: its hash of 128 bits, the order and hash of its last write, and when that came (0 if that is
#: not needed).
KNOWN = np.dtype([(c, "<i8") for c in ("k1", "k2", "written", "digest", "at")])
#: A write that goes on: all but its order is in ``record``, as JSON that keeps microseconds.
WRITE = "written long, record string"
_STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_COLUMNS = {c: t for c, t in (RECORD | CHILDREN).items()}


def latest(rows: pd.DataFrame) -> pd.DataFrame:
    """The last write of each key, by key."""
    k1, k2, written, digest = (rows[c].to_numpy() for c in ("k1", "k2", "written", "digest"))
    order = np.lexsort((digest, written, k2, k1))
    k1, k2 = k1[order], k2[order]
    return rows.iloc[order[np.append((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]), True)]]


def merged(known: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is known after fresh writes (one a key), by key, and the places of those fresh writes that are newer than what was
    known of their key and say something else."""
    both = np.concatenate([known, fresh])
    order = np.lexsort((np.arange(len(both)), both["k2"], both["k1"]))
    both = both[order]
    first = np.flatnonzero((both["k1"][1:] == both["k1"][:-1]) & (both["k2"][1:] == both["k2"][:-1]))
    old, new = both[first], both[first + 1]
    newer = (new["written"] > old["written"]) | ((new["written"] == old["written"]) & (new["digest"] > old["digest"]))
    stays = np.ones(len(both), bool)
    stays[np.where(newer, first, first + 1)] = False
    goes_on = order >= len(known)
    goes_on[first + 1] = newer & (new["digest"] != old["digest"])
    return both[stays], order[goes_on] - len(known)


class LastWrite(StatefulProcessor):
    """Of each key the latest write goes on, if it is newer than what went on before and says something else.

    Spark's unit of state is a group of keys (by hash), looked at in columns: a call for each key costs far more than the
    key's own work."""

    def __init__(self, expiry_ms: int | None):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a group that nothing was written to for so long holds no key that is younger
        self.last = handle.getValueState("last", "known binary", self.expiry_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            best = latest(part if best is None else pd.concat([best, part]))
        held = self.last.get()
        known = np.frombuffer(held[0] if held is not None else b"", KNOWN)
        now = 0
        if self.expiry_ms:
            now = timerValues.getCurrentProcessingTimeInMs()
            known = known[known["at"] + self.expiry_ms > now]
        fresh = np.empty(len(best), KNOWN)
        for c in ("k1", "k2", "written", "digest"):
            fresh[c] = best[c].to_numpy()
        fresh["at"] = now
        after, places = merged(known, fresh)
        if len(after) != len(known) or not np.array_equal(after, known):
            self.last.update((after.tobytes(),))
        if len(places):
            yield best[["written", "record"]].iloc[places]

    def close(self) -> None:
        pass


def as_writes(records: DataFrame, key: str, written: Column, groups: int = 4096) -> DataFrame:
    """Records as rows for ``LastWrite``, with the group of their key; those without a key or an order take no part."""
    record = F.to_json(F.struct(*_COLUMNS), _STAMPS)
    of = F.col(key).cast("string")
    # maps have no order of their own, so the hash is of the text of the record
    rows = records.where(F.col(key).isNotNull()).select(F.xxhash64(of).alias("k1"), F.xxhash64(F.lit("key"), of).alias("k2"), written.cast("long").alias("written"), F.xxhash64(record).alias("digest"), record.alias("record"))
    return rows.select(F.pmod("k1", F.lit(groups)).cast("int").alias("group"), "*").where("written is not null")


def from_writes(writes: DataFrame) -> DataFrame:
    """The records of writes, with ``ordinal``."""
    schema = ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())
    return writes.select(F.from_json("record", schema, _STAMPS).alias("r"), "written").select("r.*", F.col("written").alias("ordinal"))


def stateful_ingest(
    spark: SparkSession,
    landing: str,
    schema: T.StructType | str,
    normalize: Callable[[DataFrame], DataFrame],
    store: SnapshotStore,
    checkpoint: str,
    run_ts: Column,
    written: Column,
    key: str = "slug",
    format: str = "parquet",
    max_files: int | None = None,
    expiry_ms: int | None = None,
    groups: int = 4096,
    partitions: int | None = None,
) -> int:
    """Applies what has landed since the last call; returns the store's version.

    ``normalize`` makes records without shuffles; ``written`` (over its columns) orders the writes of a key, over all
    landings. A write that is older than the last one of its key, or says the same, goes no further, so the store is given
    changes only, and with a ``BucketStore`` a landing that repeats what is known rewrites nothing. A key that was not written
    for ``expiry_ms`` is forgotten; its next write is applied like a first one, whatever its age, which the store merges as
    always. After a failure the stream starts again from its checkpoint, where state and files go together; a batch that the
    store has applied already is skipped by its number.

    The state holds forty bytes a key, in ``groups`` of keys that lie in ``partitions`` (as many as the session shuffles
    into, if none are named); both are fixed by the checkpoint. A group that a landing writes to is read and kept again as a
    whole, so its keys and their new records must fit a Python worker. A partition has a state store of its own to open and
    keep in each batch, so more of them than cores cost more than they give.

    The state store must be the one that such state needs (``ROCKS``); it is set for the session if it is not."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = spark.readStream.format(format).schema(schema)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    writes = as_writes(normalize(stream.load(landing)), key, written, groups)
    last = writes.groupBy("group").transformWithStateInPandas(LastWrite(expiry_ms), WRITE, "Update", "ProcessingTime" if expiry_ms else "None")

    def apply(batch: DataFrame, number: int) -> None:
        # the state is gone through once; what goes on is read again as often as the store needs it
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/writes")
        batch.write.mode("overwrite").parquet(at.toString())
        writes = spark.read.schema(WRITE).parquet(at.toString())
        if not writes.isEmpty():
            store.apply(from_writes(writes), run_ts, batch=number)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    # with an expiry the operator asks for empty batches without end, and a call would not return; the query takes the
    # settings when it starts
    settings = {EMPTY_BATCHES: "false"} | ({PARTITIONS: str(partitions)} if partitions else {})
    was = {c: spark.conf.get(c) for c in settings}
    try:
        for c, value in settings.items():
            spark.conf.set(c, value)
        query = last.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for c, value in was.items():
            spark.conf.set(c, value)
    query.awaitTermination()
    return store.version()
