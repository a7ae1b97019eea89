"""Joins to dimensions and between parents and children. No join has a hint: whether a dimension is sent to every task is
decided by its size in bytes, before or while the plan runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def apply_overrides(df: DataFrame, overrides: DataFrame, source: str = "source", source_id: str = "source_id", order: str = "line") -> DataFrame:
    """Adds match_key: the first override of (source, source_id), else ``source:source_id``."""
    first = Window.partitionBy(source, source_id).orderBy(order)
    named = overrides.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(source, source_id, F.col("match_key").alias("_key"))
    out = df.join(named, [source, source_id], "left")
    return out.withColumn("match_key", F.coalesce("_key", F.concat_ws(":", source, source_id))).drop("_key")


def geocode_by_code(df: DataFrame, centroids: DataFrame, code: str, width: int = 5) -> DataFrame:
    """Adds lat and lon by a code that is filled up with zeros; longer codes stay as they are. Of several places for one code the smallest holds."""
    text = F.trim(F.col(code).cast("string"))
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    where = centroids.groupBy(F.col("fips5").alias("_fips")).agg(F.min(F.struct("lat", "lon")).alias("_at"))
    joined = df.withColumn("_code", padded).join(where, F.col("_code") == F.col("_fips"), "left")
    return joined.withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon")}).drop("_code", "_fips", "_at")


def label_lookup(df: DataFrame, dim: DataFrame, key: str, value: str, label: str, out: str, fallback: Column | None = None) -> DataFrame:
    """Adds the dimension's label for a key (of several the smallest), else the fallback (the key itself)."""
    names = dim.groupBy(F.col(value).alias("_value")).agg(F.min(label).alias("_label"))
    fallback = F.col(key).cast("string") if fallback is None else fallback
    joined = df.join(names, F.col(key) == F.col("_value"), "left")
    return joined.withColumn(out, F.coalesce("_label", fallback)).drop("_value", "_label")


def nest_children(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, out: str, order: list[str], values: list[str]) -> DataFrame:
    """Adds the children as an array of structs in order; [] where there are none. Children are gathered before the join."""
    entry = F.struct(*order, *[v for v in values if v not in order])
    grouped = child.groupBy(F.col(child_key).alias("_parent")).agg(F.array_sort(F.collect_list(entry)).alias(out))
    grouped = grouped.withColumn(out, F.transform(out, lambda x: F.struct(*[x[v].alias(v) for v in values])))
    kind = grouped.schema[out].dataType
    joined = parent.join(grouped, F.col(parent_key) == F.col("_parent"), "left").drop("_parent")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(kind)))


def policy_with_cause(policies: DataFrame, causes: DataFrame) -> DataFrame:
    return policies.join(F.broadcast(causes), "slug")
