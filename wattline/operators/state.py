"""Deduplication and the set-based upsert with transition deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.presets import RESOLVED_STAGES

#: Columns that an update keeps.
KEPT = ("id", "created_at", "verification_status")


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_write_wins(incoming: DataFrame, key: str = "slug", ordinal: str = "ordinal") -> DataFrame:
    return dedupe_first(incoming, [key], [F.col(ordinal).desc()])


def default_fields(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """All columns of a record (name to type): missing ones null, confidence and the aggregate flag with their defaults."""
    defaults = {"date_confidence": F.lit("exact"), "is_aggregate_example": F.lit(False)}
    have = set(df.columns)
    return df.select(*[F.coalesce(F.col(c) if c in have else F.lit(None), defaults.get(c, F.lit(None))).cast(t).alias(c) for c, t in columns.items()])


def remove_resolved(existing: DataFrame, incoming: DataFrame, key: str = "slug", stage: str = "current_stage") -> DataFrame:
    """Existing rows but those whose key comes in with a resolved stage."""
    gone = incoming.where(F.col(stage).isin(*RESOLVED_STAGES)).select(key).distinct()
    return existing.join(gone, key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, run_ts: Column, key: str = "slug", stage: str = "current_stage") -> DataFrame:
    """The next state. Incoming keys must be unique (``last_write_wins``). Resolved ones delete; others replace all
    business columns and keep id, created_at and verification_status, or start with fresh ones. One join on the key."""
    business = [c for c in existing.columns if c not in (*KEPT, "updated_at")]
    old = existing.select(F.struct("*").alias("e"), F.col(key).alias("_old"))
    new = incoming.select(F.struct(*business).alias("i"), F.col(key).alias("_new"))
    both = old.join(new, F.col("_old") == F.col("_new"), "full_outer")
    both = both.where(F.col("_new").isNull() | ~F.col(f"i.{stage}").isin(*RESOLVED_STAGES))
    fresh = {"id": F.sha2(F.col("_new").cast("string"), 256), "created_at": run_ts, "verification_status": F.lit("verified")}

    def value(c: str) -> Column:
        if c in KEPT:
            return F.coalesce(F.col(f"e.{c}"), fresh[c])
        if c == "updated_at":
            return F.when(F.col("_new").isNotNull(), run_ts).otherwise(F.col("e.updated_at"))
        return F.when(F.col("_new").isNotNull(), F.col(f"i.{c}")).otherwise(F.col(f"e.{c}"))

    return both.select(*[value(c).alias(c) for c in existing.columns])


def changes(existing: DataFrame, incoming: DataFrame, run_ts: Column, key: str = "slug", stage: str = "current_stage") -> DataFrame:
    """The key, the ``old`` row and the ``new`` row of each incoming record: no old row for an insert, no new one for a
    delete; a resolved record of an unknown key changes nothing. The new rows are those of ``upsert``. Incoming keys must be
    unique. Only incoming rows are shuffled onto what they meet, nothing else is returned."""
    business = [c for c in existing.columns if c not in (*KEPT, "updated_at")]
    old = existing.select(F.struct("*").alias("old"), F.col(key).alias("_old"))
    new = incoming.select(F.struct(*business).alias("i"), F.col(key).alias("_new"))
    fresh = {"id": F.sha2(F.col("_new").cast("string"), 256), "created_at": run_ts, "verification_status": F.lit("verified")}
    value = {c: F.coalesce(F.col(f"old.{c}"), fresh[c]) for c in KEPT} | {"updated_at": run_ts} | {c: F.col(f"i.{c}") for c in business}
    row = F.when(~F.coalesce(F.col(f"i.{stage}").isin(*RESOLVED_STAGES), F.lit(False)), F.struct(*[value[c].alias(c) for c in existing.columns]))
    both = new.join(old, F.col("_old") == F.col("_new"), "left")
    return both.select(F.col("_new").alias(key), "old", row.alias("new")).where("old is not null or new is not null")


def replace_children(existing: DataFrame, incoming: DataFrame, projects: DataFrame, touched: DataFrame, only_if_new: bool = False, key: str = "project_id") -> DataFrame:
    """The next children: those of projects that are still there and were not touched, and the incoming ones.

    ``only_if_new`` (milestones): a touched project without incoming children keeps its old ones."""
    replaced = (incoming if only_if_new else touched).select(key).distinct()
    alive = projects.select(F.col("id").alias(key)).distinct()
    kept = existing.join(replaced, key, "left_anti").join(alive, key, "left_semi")
    return kept.unionByName(incoming.join(alive, key, "left_semi"))


def merge_by_match_key(incoming: DataFrame, order: Sequence[str], key: str = "match_key") -> DataFrame:
    """One record per match key: for each column the first value that is there, in order."""
    entry = F.struct(*order)
    return incoming.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), entry)).alias(c) for c in incoming.columns if c != key])


def key_collisions(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys that more than one record has, with the smallest and largest member (not the whole group)."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(member).alias("first_member"), F.max(member).alias("last_member")).where("n > 1")


def error_rows(df: DataFrame, checks: Sequence[tuple[str, Column]], key: str = "match_key") -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and (key, message) of the first check that another row fails."""
    message = F.lit(None).cast("string")
    for text, fine in reversed(checks):
        message = F.when(~F.coalesce(fine, F.lit(False)), F.lit(text)).otherwise(message)
    marked = df.withColumn("_message", message)
    return marked.where("_message is null").drop("_message"), marked.where("_message is not null").select(key, F.col("_message").alias("message"))
