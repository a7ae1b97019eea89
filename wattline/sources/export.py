"""Writers and the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.readmodel import csv_projection, json_projection


def export_json(dto: DataFrame, path: str) -> None:
    json_projection(dto).write.option("ignoreNullFields", "false").json(path)


def export_csv(dto: DataFrame, source_labels: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, a header in each file."""
    rows = csv_projection(dto, source_labels)
    rows.write.options(header=True, quoteAll=True, quote='"', escape='"', emptyValue="").csv(path)


def build_feed(static: DataFrame, projects: DataFrame, base_url: str | Column) -> DataFrame:
    """url, last_modified, change_frequency, priority of static routes and of every project."""
    base = F.lit(base_url) if isinstance(base_url, str) else base_url
    routes = projects.select(
        F.concat(base, F.lit("/project/"), "slug").alias("url"),
        F.col("updated_at").alias("last_modified"),
        F.lit("weekly").alias("change_frequency"),
        F.lit(0.7).alias("priority"),
    )
    return static.unionByName(routes, allowMissingColumns=True)
