"""Approximate nearest neighbours by cross-polytope hashing.

A vector's direction is rotated by three rounds of random signs and the fast
Hadamard transform; the signed axis that it comes nearest to is its hash. A table
joins ``FUNCTIONS`` such hashes to a key. A query looks up, in each of ``TABLES``
tables, the keys whose axes it comes nearest to (``PROBES`` of them, by the sum
of the squared shortfalls); what it finds is measured exactly.

Vectors are dealt to shards and queries to blocks, both of bounded size; a task
makes the tables of one shard and looks up one block, and gives at most k rows a
query. Shards are dealt by row number, so vectors that are equal or alike are
spread over all of them, and in a shard equal vectors are hashed and measured
once (only the k + 1 smallest ids of them can be among the k nearest). Where a
query finds fewer than its share of ``LEAST`` vectors in a shard it is measured
against the whole shard, so tables of up to ``LEAST`` rows have exact results.

The rotations see directions only: the recall is that of vectors of like lengths
(measured at 0.985 to 1 on unit vectors of 64 components that lie at random).
Distances are the given vectors' in any case.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite
component take no part; shorter vectors are filled up with zeros; equal distances
go to the smaller id, null ids last; rows with the same id are rows of their own,
and a row never finds itself; fewer candidates than k give all of them; an empty
table gives an empty result; squares beyond a double are infinite and equal;
further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TABLES, FUNCTIONS, ROUNDS, SEED = 24, 2, 3, 11
#: Keys that a query looks up in a table.
PROBES = 128
#: Vectors that a query is measured against at least, over all shards.
LEAST = 4096
#: Queries that are rotated together.
TOGETHER = 256


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``_id``, ``_v`` (as doubles) and ``_row`` of the vectors that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return cut(df.where(v.isNotNull() & fine).select(F.col(id_col).alias("_id"), F.transform(v, lambda x: x.cast("double")).alias("_v"), F.monotonically_increasing_id().alias("_row")))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out + 0.0  # so that -0.0 is 0.0


def units(x: np.ndarray, size: int) -> np.ndarray:
    """Directions, filled up to ``size`` components."""
    x = x / np.abs(x).max(1, keepdims=True)
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x / np.sqrt((x * x).sum(1, keepdims=True))
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row, scaled to keep lengths."""
    n, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(n, size // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        half *= 2
    return x / np.sqrt(size)


class Tables:
    """Keys of directions, and the keys near a direction."""

    def __init__(self, width: int):
        self.size = 1 << max(0, width - 1).bit_length()
        self.signs = np.random.default_rng(SEED).integers(0, 2, (TABLES, FUNCTIONS, ROUNDS, self.size)) * 2.0 - 1
        axes = 2 * self.size
        self.probes = min(PROBES, axes**FUNCTIONS)
        # two ranks whose keys can be among the first: all keys of smaller ranks come before
        i, j = np.meshgrid(np.arange(axes), np.arange(axes), indexing="ij")
        near = (i + 1) * (j + 1) <= self.probes
        self.ranks = i[near], j[near]

    def rotated(self, unit: np.ndarray, table: int, function: int) -> np.ndarray:
        for signs in self.signs[table, function]:
            unit = hadamard(unit * signs)
        return unit

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A row for each table: table and nearest signed axes in one number."""
        out = np.empty((TABLES, len(unit)), np.int64)
        rows = np.arange(len(unit))
        for t in range(TABLES):
            key = np.full(len(unit), t, np.int64)
            for f in range(FUNCTIONS):
                turned = self.rotated(unit, t, f)
                axis = np.abs(turned).argmax(1)
                key = key * (2 * self.size) + 2 * axis + (turned[rows, axis] < 0)
            out[t] = key
        return out

    def near_keys(self, unit: np.ndarray) -> np.ndarray:
        """For each direction the keys of all tables to look up."""
        rows, found = np.arange(len(unit))[:, None], []
        for t in range(TABLES):
            ordered, short = [], []
            for f in range(FUNCTIONS):
                turned = self.rotated(unit, t, f)
                both = np.empty((len(unit), 2 * self.size))
                both[:, 0::2], both[:, 1::2] = turned, -turned
                order = np.argsort(-both, axis=1, kind="stable")
                best = both[rows, order]
                ordered.append(order)
                short.append((best[:, :1] - best) ** 2)
            i, j = self.ranks
            total = short[0][:, i] + short[1][:, j]
            if len(i) > self.probes:
                chosen = np.argpartition(total, self.probes - 1, axis=1)[:, : self.probes]
            else:
                chosen = np.broadcast_to(np.arange(len(i)), total.shape)
            key = (t * 2 * self.size + ordered[0][rows, i[chosen]]) * (2 * self.size) + ordered[1][rows, j[chosen]]
            found.append(key)
        return np.concatenate(found, axis=1)


class Shard:
    """The tables of a shard. ``rank`` orders its rows: ties of distances go by it."""

    def __init__(self, x: np.ndarray, rank: np.ndarray, k: int, tables: Tables):
        self.k, self.tables = k, tables
        order = np.argsort(rank, kind="stable")
        raw = np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        self.x = x[order][first]
        # the rows of each different vector, smallest ranks first, and of them k + 1
        grouped = np.argsort(which, kind="stable")
        begins = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(first)))])
        self.members = [order[grouped[a : min(b, a + k + 1)]] for a, b in zip(begins[:-1], begins[1:], strict=True)]
        self.rank = rank
        keys = tables.keys(units(self.x, tables.size)).ravel()
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[by_key], by_key % max(1, len(self.x))
        with np.errstate(over="ignore"):
            self.square = (self.x * self.x).sum(1)

    def candidates(self, near: np.ndarray, least: int) -> np.ndarray:
        """Places of the different vectors that the keys find."""
        low, high = np.searchsorted(self.keys, near, "left"), np.searchsorted(self.keys, near, "right")
        many = high - low
        ends = np.cumsum(many)
        found = self.places[np.arange(ends[-1]) + np.repeat(low - ends + many, many)]
        seen = np.zeros(len(self.x), bool)
        seen[found] = True
        places = np.flatnonzero(seen)
        return places if len(places) >= least else np.arange(len(self.x))

    def nearest(self, q: np.ndarray, places: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest among the places. ``own`` is the query's own row or -1."""
        if len(places) > self.k + 1:
            with np.errstate(over="ignore", invalid="ignore"):
                rough = self.square[places] - 2 * (self.x[places] @ q)
                slack = 1e-9 * (self.square[places].max() + q @ q)
                # k + 1 different vectors hold k rows besides the query's own
                close = rough <= np.partition(rough, self.k)[self.k] + slack
            if np.isfinite(rough).all() and np.isfinite(slack):
                places = places[close]
        with np.errstate(over="ignore"):
            d = self.x[places] - q
            far = np.sqrt(np.cumsum(d * d, axis=1)[:, -1])
        rows = np.concatenate([self.members[p] for p in places])
        far = np.repeat(far, [len(self.members[p]) for p in places])
        others = rows != own
        rows, far = rows[others], far[others]
        best = np.lexsort((self.rank[rows], far))[: self.k]
        return rows[best], far[best]


def _search(k: int, width: int, shards: int):
    columns = ["_query", "_query_id", "_query_null", "_id", "_null", "_row", "score"]

    def task(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({c: [] for c in columns})
        x, q = matrix(shard["_v"], width), matrix(queries["_v"], width)
        rows, ids, nulls = (shard[c].to_numpy() for c in ("_row", "_id", "_null"))
        rank = np.empty(len(shard), np.int64)
        rank[np.lexsort((rows, ids, nulls))] = np.arange(len(shard))
        tables = Tables(width)
        index = Shard(x, rank, k, tables)
        place = {r: i for i, r in enumerate(rows.tolist())}
        found = []
        for at in range(0, len(q), TOGETHER):
            near = tables.near_keys(units(q[at : at + TOGETHER], tables.size))
            part = queries.iloc[at : at + TOGETHER]
            for vector, keys, row, vec_id, null in zip(q[at:], near, part["_row"], part["_id"], part["_null"], strict=False):
                best, far = index.nearest(vector, index.candidates(keys, -(-LEAST // shards)), place.get(row, -1))
                found.append(pd.DataFrame({"_query": row, "_query_id": vec_id, "_query_null": null, "_id": ids[best], "_null": nulls[best], "_row": rows[best], "score": far}))
        return pd.concat(found)

    return task


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, shard_rows: int | None = None, spread: int = 16) -> DataFrame:
    """For ``usable_vectors``: query_id, rank, vec_id, score of the k nearest found for each row that ``is_query`` (on
    ``_id``) picks.

    A shard has a ``spread``-th of the rows, but from 512 to ``shard_rows`` (as many as four million numbers hold); a
    block has up to ``shard_rows`` queries."""
    n, n_queries, width = vectors.agg(F.count("*"), F.count_if(is_query), F.max(F.size("_v"))).first()
    width = int(width or 1)
    shard_rows = shard_rows or max(512, 2**22 // width)
    kind = vectors.schema["_id"].dataType.simpleString()
    size = max(512, min(shard_rows, -(-n // spread)))
    shards, blocks = max(1, -(-n // size)), max(1, -(-(n_queries or 0) // shard_rows))
    # the task's group is one bounded shard and one bounded block; row numbers spread equal vectors and ids alike
    dealt = F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int").alias("_shard")
    block = F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_block")
    # ids go to Python without nulls, since pandas would make doubles of them
    vectors = vectors.select(F.coalesce("_id", F.lit(0).cast(kind)).alias("_id"), F.col("_id").isNull().alias("_null"), "_v", "_row", is_query.alias("_asks"))
    left = vectors.drop("_asks").select("*", dealt).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = vectors.where("_asks").drop("_asks").select("*", block).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInPandas(
        _search(k, width, shards), f"_query long, _query_id {kind}, _query_null boolean, _id {kind}, _null boolean, _row long, score double"
    )
    merged = Window.partitionBy("_query").orderBy("score", "_null", "_id", "_row")
    ranked = found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
    return ranked.select(F.when(~F.col("_query_null"), F.col("_query_id")).alias("query_id"), "rank", F.when(~F.col("_null"), F.col("_id")).alias("vec_id"), "score")


def op11_query(embeddings: DataFrame) -> DataFrame:
    return nearest(usable_vectors(embeddings), F.col("_id") % 100 == 0)
