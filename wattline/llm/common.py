"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The six characters that separate words and are stripped from lines: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
#: One word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the one the cluster names in ``spark.checkpoint.dir``. Only a local session
    without that setting (a test) gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows as one struct, ``_doc``, beside the given columns, so that no name of a table can clash with one of ours."""
    return df.select(F.struct("*").alias("_doc"), *[c.alias(n) for n, c in columns.items()])


def by_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], schema: str | StructType) -> DataFrame:
    """Arrow batches through a function. ``make`` runs once a task; columns pass as Arrow, so null ids stay whole numbers."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = make()
        for frame in frames:
            yield pa.RecordBatch.from_pydict(do(frame))

    return df.mapInArrow(batches, schema)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character kept. All-ASCII values take the quicker built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def identity(text_col: str) -> Column:
    """128 bits that stand for a text; a null text is the empty one."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def fan_out(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
