"""Centroid clustering of whole-number vectors, with a progressive search over Walsh-Hadamard coefficients.

A vector and the centroids are transformed exactly (whole numbers, no division);
by Parseval the squared distance is the sum of the squared differences of the
coefficients, divided by their number. The search adds the differences coarse to
fine, in order of sign changes, one group of coefficients after the other. After
each group the centroid that leads is measured to the end, which bounds the best
distance from above, and centroids whose sum so far is strictly greater are
dropped. Those that remain have all coefficients, so distances and ties are exact.

A round is one pass over the vectors: each task adds up its vectors by centroid,
Spark adds up the tasks' sums, and only they (k x width numbers) come to the
driver, which gives the next centroids. The vectors are never shuffled.

Edge cases: vectors that are null, of another width, or hold a null or non-finite
component take no part and have no row; components beyond a long are its bounds;
distances and sums beyond a long are compared exactly and given as its bound;
rows without an id are clustered, but no centroid starts from them; of repeated
ids each row counts, and starts in the order of its components; fewer vectors
than centroids give fewer centroids; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LONG = 2**63
#: Components up to here keep all sums of squares of 64 coefficients within a long; greater ones are reckoned with Python's integers.
SMALL = 2**20
#: Vectors that are searched together.
TOGETHER = 4096


def whole(values: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x), as longs where all are small, else as Python's integers within the bounds of a long."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    bounded = [[int(x) if abs(x) < LONG else LONG - 1 if x > 0 else -LONG for x in row] for row in scaled]
    return np.array(bounded, object).reshape(scaled.shape)


def walsh_order(width: int) -> np.ndarray:
    """The coefficients of the transform by their number of sign changes."""
    rows = transform(np.eye(width, dtype=np.int64))
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """The exact Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
        half *= 2
    return x


def levels(width: int) -> list[tuple[int, int]]:
    """Groups of coefficients, each as many as all before it."""
    ends = [2**i for i in range(width.bit_length())]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def progressive(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For rows of coefficients in Walsh order: the nearest centroid (ties: the smaller number), its squared distance, and
    how many differences of coefficients were reckoned."""
    n, width = x.shape
    rows, done = np.arange(n), 0
    sums, alive = np.zeros((n, len(c)), x.dtype), np.ones((n, len(c)), bool)
    never = LONG - 1 if x.dtype != object else 2**200
    bound = None
    for first, last in levels(width):
        r, j = np.nonzero(alive)
        d = x[r, first:last] - c[j, first:last]
        sums[r, j] += (d * d).sum(1)
        done += len(r) * (last - first)
        lead = np.where(alive, sums, never).argmin(1)
        if last == width:
            break
        rest = x[:, last:] - c[lead, last:]
        done += n * (width - last)
        full = sums[rows, lead] + (rest * rest).sum(1)
        bound = full if bound is None else np.minimum(bound, full)
        alive &= sums <= bound[:, None]
    return lead, sums[rows, lead] // width, done


class Search:
    """Assigns vectors of whole numbers to fixed centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.width = len(centroids[0])
        self.order = walsh_order(self.width)
        values = np.array(centroids, object)
        small = all(abs(x) < SMALL for c in centroids for x in c)
        self.wide = transform(values)[:, self.order]
        self.narrow = self.wide.astype(np.int64) if small else None

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, far = [np.zeros(0, np.int64)], [np.zeros(0, x.dtype)]
        c = self.wide if x.dtype == object or self.narrow is None else self.narrow
        for at in range(0, len(x), TOGETHER):
            part = x[at : at + TOGETHER].astype(c.dtype)
            best, distance, _ = progressive(transform(part)[:, self.order], c)
            near.append(best)
            far.append(distance)
        return np.concatenate(near), np.concatenate(far)


def kept_vectors(column: pa.Array, width: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Places of the vectors that take part, and their whole numbers."""
    places = pc.indices_nonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False))
    values = column.take(places).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    finite = np.isfinite(values).all(1)
    return places.filter(pa.array(finite)), whole(values[finite], scale)


def starts(df: DataFrame, k: int, id_col: str, vec_col: str, width: int, scale: int, salt: str) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    named = df.where((F.size(v) == width) & fine & F.col(id_col).isNotNull())
    hashed = named.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")), 256).alias("hash"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    first = hashed.orderBy("hash", "v").limit(k).collect()
    return [[int(x) for x in whole(np.array([r["v"]], np.float64), scale)[0]] for r in first]


def _totals(vectors: DataFrame, centroids: list[list[int]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that has vectors their number and the sums of their components."""
    k, width = len(centroids), len(centroids[0])
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, sums = Search(shared.value), np.zeros(k, np.int64), np.zeros((k, width), object)
        for frame in frames:
            _, x = kept_vectors(frame["_v"], width, scale)
            near, _ = search(x)
            for j in np.unique(near):
                mine = x[near == j]
                counts[j] += len(mine)
                sums[j] += mine.sum(0)
        used = np.flatnonzero(counts)
        totals = [[Decimal(int(s)) for s in sums[j]] for j in used]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(counts[used]), "totals": pa.array(totals, pa.list_(pa.decimal128(38, 0)))})

    made = vectors.mapInArrow(add, "cluster int, n long, totals array<decimal(38,0)>")
    each = made.select("cluster", "n", F.posexplode("totals").alias("place", "total"))
    # k x width rows at most
    rows = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["cluster"], r["place"])):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return out


def lloyd(vectors: DataFrame, centroids: list[list[int]], rounds: int, scale: int) -> list[list[int]]:
    """The centroids after so many rounds: floors of the means; one without vectors stays."""
    for _ in range(rounds):
        totals = _totals(vectors, centroids, scale)
        centroids = [[s // totals[j][0] for s in totals[j][1]] if j in totals else c for j, c in enumerate(centroids)]
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """``_id``, ``cluster`` and ``distance`` of each vector that takes part."""
    width = len(centroids[0])
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema["_id"].dataType.simpleString()

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value)
        for frame in frames:
            places, x = kept_vectors(frame["_v"], width, scale)
            near, far = search(x)
            distance = pa.array([min(int(d), LONG - 1) for d in far], pa.int64()) if far.dtype == object else pa.array(far)
            yield pa.RecordBatch.from_pydict({"_id": frame["_id"].take(places), "cluster": pa.array(near, pa.int32()), "distance": distance})

    return vectors.mapInArrow(batches, f"_id {kind}, cluster int, distance long")


def centroid_clusters(
    df: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", width: int = 64, scale: int = 256, salt: str = "2"
) -> DataFrame:
    """The id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each vector."""
    vectors = df.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"))
    first = starts(df, k, id_col, vec_col, width, scale, salt)
    if not first:
        # no vector with an id takes part: one centroid at zero, so that rows without ids have a result
        first = [[0] * width]
    centroids = lloyd(vectors, first, rounds, scale)
    assigned = cut(assign(vectors, centroids, scale))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    by_cluster = {r["cluster"]: int(r["s"]) for r in sums}
    within = F.array(*[F.lit(min(by_cluster.get(j, 0), LONG - 1)).cast("long") for j in range(len(centroids))])
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    at = F.col("cluster") + 1
    return assigned.select(
        F.col("_id").alias(id_col), "cluster", "distance", F.element_at(within, at).alias("cluster_inertia"),
        F.lit(min(sum(by_cluster.values()), LONG - 1)).cast("long").alias("inertia"), F.element_at(names, at).alias("centroid_sha256"),
    )


def op13_query(embeddings: DataFrame) -> DataFrame:
    return centroid_clusters(embeddings)
