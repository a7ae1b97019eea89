"""Corpus-wide removal of repeated lines.

Lines are exploded, normalised (stripped, A-Z lower-cased) and hashed; a hash
that stands in at least two documents is repeated, and all its lines go but
those in the document with the smallest id. Only hashes and positions are
shuffled by line; a document's text moves once, to meet the positions it loses.
Lines that make up over a ``FREQUENT``-th of all repeated ones (there are at most
so many of those) are counted before the shuffle and marked where they are read;
only the others meet their first document by a shuffle.

Edge cases: a null or empty text is one empty line; a document whose id is null
never holds a line's first copy and does not count as a holder; of rows with
one id, all keep the lines they hold first; keys under ``min_chars`` code points
stay; other columns are kept, but for those called n_lines and n_dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, cut, packed

#: Lines this frequent are not shuffled: one in so many of the repeated lines.
FREQUENT = 1000


def _lines(text_col: str):
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def _keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line that may go: document, position, and 128 bits of the key's hash."""
    exploded = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.posexplode(_lines(text_col)).alias("_pos", "_line"))
    key = F.trim(F.col("_line"), F.lit(SPACES))
    exploded = exploded.select("_id", "_text", "_pos", key.alias("_key")).where(F.char_length("_key") >= min_chars)
    key = ascii_lower(F.col("_key"))
    return exploded.select("_id", "_text", "_pos", key.alias("_key")).select("_id", "_text", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text_col`` replaced by the lines that stay, and ``n_lines`` and ``n_dropped``."""
    keys = _keys(docs, id_col, text_col, min_chars)
    if min_docs == 2:
        repeated = keys.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_other"), F.count("*").alias("_lines")).where("_first < _other")
    else:
        holders = keys.select("_h1", "_h2", "_id").where("_id is not null").distinct()
        repeated = holders.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines")).where(F.col("_lines") >= min_docs)
    repeated = cut(repeated.select("_h1", "_h2", "_first", "_lines"))
    often = (repeated.agg(F.sum("_lines")).first()[0] or 0) // FREQUENT
    # at most FREQUENT rows
    frequent = F.broadcast(repeated.where(F.col("_lines") > often).select("_h1", "_h2", F.col("_first").alias("_known")))
    marked = keys.join(frequent, ["_h1", "_h2"], "left")
    rare = marked.where("_known is null").join(repeated.where(F.col("_lines") <= often), ["_h1", "_h2"])
    gone = rare.select("_id", "_text", "_pos", "_first").union(marked.where("_known is not null").select("_id", "_text", "_pos", F.col("_known").alias("_first")))
    gone = gone.where(~F.col("_id").eqNullSafe(F.col("_first")))
    gone = gone.groupBy("_id", "_text").agg(F.sort_array(F.collect_set("_pos")).alias("_gone"))
    # null ids meet in the join as well, hence a value for them beside the flag
    mark = lambda c: [F.coalesce(c, F.lit("")).alias("_k"), c.isNull().alias("_n")]
    gone = gone.select(*mark(F.col("_id").cast("string")), F.col("_text").alias("_t"), "_gone")
    rows = packed(docs, _id=F.col(id_col), _body=F.col(text_col)).select("_doc", *mark(F.col("_id").cast("string")), F.xxhash64("_body").alias("_t"), _lines("_body").alias("_lines"), "_body")
    joined = rows.join(gone, ["_k", "_n", "_t"], "left")
    # what stays are the runs of lines between those that go
    before = F.concat(F.array(F.lit(-1)), F.col("_gone"))
    behind = F.concat(F.col("_gone"), F.array(F.size("_lines")))
    runs = F.transform(F.arrays_zip(before.alias("a"), behind.alias("b")), lambda r: F.slice(F.col("_lines"), r["a"] + 2, r["b"] - r["a"] - 1))
    kept = F.when(F.col("_gone").isNull(), F.coalesce("_body", F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))
    counts = {"n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    own = [kept.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns if c not in counts]
    return joined.select(*own, *[v.alias(k) for k, v in counts.items()])


def op3_query(docs: DataFrame) -> DataFrame:
    kept = drop_repeated_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
