"""Each newly landed edition is ingested once; an unchanged folder does nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.snapshots import SnapshotStore


def incremental_ingest(
    spark: SparkSession,
    landing: str,
    schema: StructType | str,
    normalize: Callable[[DataFrame], DataFrame],
    store: SnapshotStore,
    checkpoint: str,
    run_ts: Column,
    format: str = "parquet",
    max_files: int | None = None,
) -> int:
    """Applies what has landed since the last call, file by file in ``max_files`` at a time; returns the store's version.

    The stream's checkpoint remembers the files, the store remembers the batches, so a batch that is delivered again
    after a failure is applied once."""
    stream = spark.readStream.format(format).schema(schema)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)

    def apply(batch: DataFrame, number: int) -> None:
        store.apply(normalize(batch), run_ts, batch=number)

    query = stream.load(landing).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.version()
