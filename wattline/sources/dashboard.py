"""The dashboard's dataset landed by sector, so that a scan of some sectors reads their folders only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.presets import SECTOR_TYPE
from .readers import DASHBOARD_SCHEMA, ORDINAL, landed_at

_CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The dataset's rows of all sectors with ``_ordinal``, and the lines that are no such JSON: file, line (its place among
    the lines of its part of the file), message and text."""
    schema = T.StructType([*DASHBOARD_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])
    text = spark.read.text(path).select("value", landed_at().alias(ORDINAL)).where(F.trim("value") != "")
    rows = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("r"), "value", ORDINAL)
    broken = rows.where(F.col("r").isNull() | F.col(f"r.{_CORRUPT}").isNotNull())
    fine = rows.where(F.col("r").isNotNull() & F.col(f"r.{_CORRUPT}").isNull()).select(*[F.col(f"r.{c}") for c in DASHBOARD_SCHEMA.names], ORDINAL)
    return fine, broken.select(F.col(f"{ORDINAL}.file").alias("file"), F.col(f"{ORDINAL}.line").alias("line"), F.lit("no row of the dataset").alias("message"), F.col("value").alias("text"))


def land_by_sector(rows: DataFrame, folder: str) -> None:
    """Writes rows (with ``_ordinal``) with a folder for each sector."""
    rows.write.mode("append").partitionBy("project_sector").parquet(folder)


def scan_sectors(spark: SparkSession, folder: str, sectors: Sequence[str] | None = None) -> DataFrame:
    """Rows of some sectors (those of interest, if none are named); the other sectors' folders are not listed as input."""
    schema = T.StructType([*DASHBOARD_SCHEMA.fields, T.StructField(ORDINAL, T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("line", T.LongType())]))])
    rows = spark.read.schema(schema).parquet(folder)
    return rows.where(F.col("project_sector").isin(*(SECTOR_TYPE if sectors is None else sectors)))
