"""Exact top-k by inner product with MaxScore.

A component is a term, a vector's value there its posting. Vectors are dealt to
shards and queries to blocks, both of bounded size; each task holds one shard
(its postings, one row of values a term) and one block. For a query the terms'
contributions are bounded over the shard; the terms whose bounds together could
still reach the k-th best score so far are essential. Their postings are
traversed for all vectors; the other terms are probed, highest bound first, only
for vectors that remain competitive. The shards' lists are merged at the end.

Edge cases: vectors that are null, empty or hold a null or non-finite component
take no part; shorter vectors are filled up with zeros; equal scores go to the
smaller id, null ids last; rows with the same id are rows of their own, and a
row never finds itself; fewer candidates than k give fewer rows; an empty table
gives an empty result; components beyond a long are its bounds, and so are scores
beyond it (they are ranked by their exact values); further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Terms that are probed together.
STRIDE = 8
#: Vectors scored in full to get a first bound.
SEEDS = 32


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``_id``, ``_v`` (floor(scale * x) for each component) and ``_row``, for the vectors that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return cut(df.where(v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(id_col).alias("_id"), ints.alias("_v"), F.monotonically_increasing_id().alias("_row")))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def maxscore(postings: np.ndarray, query: np.ndarray, k: int, own: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best vectors; ``own`` is the query's own place or -1. ``ids`` are ranks, so ties end there."""
    n = postings.shape[1]
    high, low = postings.max(1) * query, postings.min(1) * query
    top, floor = np.maximum(high, low), np.minimum(high, low)
    terms = np.argsort(-(top - floor), kind="stable")
    rest = np.concatenate([np.cumsum(top[terms][::-1])[::-1], [0]])  # what the terms from here on can add
    others = np.arange(n) != own
    bound = -np.inf
    ready = min(STRIDE, len(terms))
    partial = query[terms[:ready]] @ postings[terms[:ready]]
    if n > SEEDS + k:
        seeds = np.argpartition(-partial, SEEDS)[:SEEDS]
        seen = np.sort(query @ postings[:, seeds[others[seeds]]])
        bound = seen[-k] if len(seen) >= k else bound
    # essential are the terms up to the place from which on the bounds no longer lift every vector to the bound
    alive = np.flatnonzero(others)
    partial = partial[alive]
    while ready < len(terms):
        competitive = partial + rest[ready] >= bound
        step = terms[ready : ready + STRIDE]
        alive, partial = alive[competitive], partial[competitive]
        partial = partial + (query[step] @ (postings[step][:, alive] if len(alive) < n else postings[step]))
        ready += STRIDE
    order = best(partial, ids[alive], k)
    return alive[order], partial[order]


#: A score in three whole numbers that are ordered as it is, whatever its size.
KEY = ["_high", "_middle", "_low"]


def _key(scores: np.ndarray) -> dict[str, np.ndarray]:
    part = 2**48 - 1
    high = scores >> (96 if scores.dtype == object else 63)
    return {c: v.astype(np.int64) for c, v in zip(KEY, (high, scores >> 48 & part, scores & part), strict=True)}


def _search(k: int, width: int):
    columns = ["_query", "_query_id", "_query_null", "_id", "_null", "_row", "score", *KEY]

    def task(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({c: [] for c in columns})
        x, q = matrix(shard["_v"], width), matrix(queries["_v"], width)
        # whole numbers stay exact in doubles below 2^53, and in longs below 2^63
        largest = max(-int(x.min()), int(x.max())) * max(-int(q.min()), int(q.max())) * width
        kind = np.float64 if largest < 2**52 else np.int64 if largest < 2**62 else object
        x, q = x.astype(kind), q.astype(kind)
        postings = np.ascontiguousarray(x.T)
        rows = shard["_row"].to_numpy()
        rank = np.empty(len(shard), np.int64)
        rank[shard.sort_values(["_null", "_id", "_row"]).index] = np.arange(len(shard))
        place = {r: i for i, r in enumerate(rows)}
        found = []
        for i, (row, vec_id, null) in enumerate(zip(queries["_row"], queries["_id"], queries["_null"], strict=True)):
            at, scores = maxscore(postings, q[i], k, place.get(row, -1), rank)
            places = shard.iloc[at]
            scores = scores if scores.dtype == object else scores.astype(np.int64)
            values = {"_query": row, "_query_id": vec_id, "_query_null": null, "_id": places["_id"], "_null": places["_null"], "_row": rows[at]}
            found.append(pd.DataFrame(values | {"score": scores.clip(-(2**63), 2**63 - 1).astype(np.int64)} | _key(scores)))
        return pd.concat(found)

    return task


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 65536, spread: int = 32) -> DataFrame:
    """For ``integer_vectors``: query_id, rank, vec_id, score of the k best for each row that ``is_query`` (on ``_id``) picks.

    A shard has a ``spread``-th of the rows, but from 1,024 to ``shard_rows``; a block has up to ``shard_rows`` queries."""
    n, n_queries, width = vectors.agg(F.count("*"), F.count_if(is_query), F.max(F.size("_v"))).first()
    kind = vectors.schema["_id"].dataType.simpleString()
    size = max(1024, min(shard_rows, -(-n // spread)))
    shards, blocks = max(1, -(-n // size)), max(1, -(-(n_queries or 0) // shard_rows))
    # the task's group is one bounded shard and one bounded block; row numbers spread equal vectors and ids alike
    dealt = F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int").alias("_shard")
    block = F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_block")
    # ids go to Python without nulls, since pandas would make doubles of them
    vectors = vectors.select(F.coalesce("_id", F.lit(0).cast(kind)).alias("_id"), F.col("_id").isNull().alias("_null"), "_v", "_row", is_query.alias("_asks"))
    left = vectors.drop("_asks").select("*", dealt).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = vectors.where("_asks").drop("_asks").select("*", block).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInPandas(
        _search(k, int(width or 1)), f"_query long, _query_id {kind}, _query_null boolean, _id {kind}, _null boolean, _row long, score long, _high long, _middle long, _low long"
    )
    merged = Window.partitionBy("_query").orderBy(*[F.col(c).desc() for c in KEY], "_null", "_id", "_row")
    ranked = found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
    return ranked.select(F.when(~F.col("_query_null"), F.col("_query_id")).alias("query_id"), "rank", F.when(~F.col("_null"), F.col("_id")).alias("vec_id"), "score")


def op5_query(embeddings: DataFrame) -> DataFrame:
    return top_k(integer_vectors(embeddings), F.col("_id") % 50 == 0)
