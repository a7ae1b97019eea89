"""Contiguous shards of equal bytes.

Documents are put in the order of their id. Each range of that order is summed,
the totals of the ranges are turned into offsets, and every document gets the
number of bytes that stand before it; the global sequence of bytes is then cut
at equal targets. A document belongs to the shard that holds its middle.

Edge cases: a null text has no bytes (size 1, CRC 0); null ids come first;
documents of one id are ordered by CRC and size, equal rows by where they are
read, so that they do not meet in one task, and may be split by a cut; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .sweep import ordered, running

KEY = ["_id", "_crc", "_size"]


def _key(id_col: str, text_col: str) -> list[Column]:
    text = F.col(text_col)
    return [
        F.col(id_col).alias("_id"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("_crc"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("_size"),
    ]


def place(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id``, ``_crc``, ``_size``, ``shard``, ``slot`` (its place in the shard, from 0)."""
    order = [*KEY, "_tie"]
    rows = ordered(docs.select(*_key(id_col, text_col), F.monotonically_increasing_id().alias("_tie")), *order)
    total = rows.agg(F.sum("_size")).first()[0] or 1
    at = running(rows, order, {"_start": F.col("_size"), "_row": F.lit(1)})
    middle = F.expr(f"(2 * _start + _size) * {int(n_shards)} div (2 * {int(total)})")
    at = at.withColumn("shard", F.least(F.lit(n_shards - 1), middle).cast("int"))
    firsts = at.groupBy("shard").agg(F.min("_row").alias("_first"))
    # one row for each shard
    return at.join(F.broadcast(firsts), "shard").select(*KEY, "shard", (F.col("_row") - F.col("_first")).alias("slot"))


#: Rows that equal a cut are dealt by this many equal steps, ``STEP`` (the golden ratio of them) apart for rows in turn.
STEPS, STEP = 1 << 20, 648055


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns and ``shard``. What returns to the driver are the cuts: the first key of each
    shard, and how the rows of these keys are dealt to shards (at most two numbers a shard). The texts stay where they are.

    Rows that equal a cut in id and text are dealt to the shards that such rows have, in the same shares, by where they are
    read: a large group of equal rows is spread like any others."""
    placed = cut(place(docs, n_shards, id_col, text_col))
    firsts = placed.groupBy("shard").agg(F.min(F.struct(*KEY)).alias("k")).where("shard > 0").select("k.*").distinct()
    # one row for each shard at most
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in KEY]
    at_cuts = placed.alias("p").join(F.broadcast(firsts).alias("f"), reduce(lambda a, b: a & b, same)).groupBy(*[f"p.{c}" for c in KEY], "p.shard").agg(F.count("*").alias("n"))
    shares: dict[tuple, dict[int, int]] = {}
    for r in at_cuts.collect():
        shares.setdefault(tuple(r[c] for c in KEY), {})[r["shard"]] = r["n"]
    kind = dict(docs.dtypes)[id_col]
    turn = F.pmod(F.pmod(F.monotonically_increasing_id(), F.lit(STEPS)) * STEP, F.lit(STEPS))
    rows, key = docs.select(F.struct("*").alias("_doc"), *_key(id_col, text_col), turn.alias("_turn")), F.struct(*KEY)
    shard = F.lit(0)
    for values, by_shard in sorted(shares.items(), key=lambda x: max(x[1])):
        here = F.struct(F.lit(values[0]).cast(kind).alias("_id"), F.lit(values[1]).cast("long").alias("_crc"), F.lit(values[2]).cast("long").alias("_size"))
        total, before, dealt = sum(by_shard.values()), 0, F.lit(None).cast("int")
        ends = []
        for s, n in sorted(by_shard.items()):
            before += n
            ends.append((before * STEPS // total, s))
        for end, s in reversed(ends):
            dealt = F.when(F.col("_turn") < end, F.lit(s)).otherwise(dealt)
        shard = F.when(key > here, F.lit(max(by_shard))).when(key == here, dealt).otherwise(shard)
    names = docs.columns if "shard" in docs.columns else [*docs.columns, "shard"]
    return rows.select(*[shard.alias(c) if c == "shard" else F.col(f"_doc.`{c}`") for c in names])


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, **columns: str) -> None:
    """Writes each shard to a folder of its own."""
    shard_documents(docs, n_shards, **columns).write.partitionBy("shard").parquet(path)


def op9_query(docs: DataFrame) -> DataFrame:
    return place(docs).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
