"""Near-duplicates by SimHash fingerprints and an anchor-point covering.

The anchors are the words of the Hamming code on the first 63 bits: every
63-bit string is within one bit of exactly one anchor (covering radius 1). Of
two fingerprints at most t bits apart some string lies within ceil(t / 2) of
both, and its anchor within one bit more; so each fingerprint goes to all
anchors within 1 + ceil(t / 2) (for t = 2: up to 32), inside the covering radius
plus the threshold, and no pair is missed. Fingerprints that meet at an anchor are compared
on all 64 bits. An anchor's group is bounded by the code (each of its
fingerprints is within two bits of it), as equal fingerprints are one node;
a group links each member to one other, not all pairs.

Edge cases: a null or blank text has the fingerprint zero, which links like any
other; short texts are one shingle; the smallest id ignores nulls and is null
where a component has no other; repeated rows share a fingerprint; an empty
table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, cut, fan_out, identity, packed
from .components import components

SEED = 42
#: Words hashed at once; a longer text is counted in parts.
PART = 1 << 16


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``width`` lower-cased words (bytes.lower and bytes.split know ASCII only), in parts."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, PART):
        hi = min(n, lo + PART)
        some = words[lo : hi + width - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: hi - lo].tolist()
        stops = ends[min(width, len(some)) - 1 :][: hi - lo].tolist()
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, hi - lo)


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, from bit 63 down."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash: a bit is set if it is in over half of the shingles' hashes."""
    n, votes = 0, np.zeros(64, np.int64)
    for part in shingle_hashes(text, width):
        n += len(part)
        votes += bit_votes(part)
    return int(np.packbits(2 * votes > n).view(">i8")[0]) if n else 0


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_hash`` (MD5 of the text) and ``_fp`` for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def prints(frame: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"_id": frame["_id"], "_hash": frame["_hash"], "_fp": pa.array([fingerprint(t, width) for t in frame["_text"].to_pylist()], pa.int64())}

    texts = docs.select(F.col(id_col).alias("_id"), identity(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    return by_batch(texts, lambda: prints, f"_id {kind}, _hash string, _fp long")


def _syndrome(fp: Column) -> Column:
    """XOR of the numbers 1 to 63 of the bits that are set, bit 63 left out: 0 for the code's words."""
    out = F.lit(0)
    for k in range(6):
        mask = sum(1 << (i - 1) for i in range(1, 64) if i >> k & 1)
        out = out + F.pmod(F.bit_count(fp.bitwiseAND(F.lit(mask))), F.lit(2)) * (1 << k)
    return out


def anchors(fp: Column, reach: int) -> Column:
    """The code's words within ``reach`` (1 or 2) bits of the first 63 bits of a fingerprint."""
    low = fp.bitwiseAND(F.lit((1 << 63) - 1))
    s = _syndrome(fp)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)
    nearest = F.when(s == 0, low).otherwise(low.bitwiseXOR(bit(s.cast("int"))))
    if reach == 1:
        return F.array(nearest)
    # two bits i and j lead to a word if i ^ j is the syndrome; i = s would leave j = 0
    firsts = F.filter(F.sequence(F.lit(1), F.lit(63)), lambda i: (s != 0) & (i < i.bitwiseXOR(s.cast("int"))) & (i != s))
    two = F.transform(firsts, lambda i: low.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(s.cast("int")))))
    return F.concat(F.array(nearest), two)


def _joined(group: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning edge for every member of a bounded group that another member is close to."""
    values = group.view(np.uint64)
    left, edges = np.arange(len(values)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            near = np.bitwise_count(values[left] ^ values[at]) <= threshold
            edges += [(int(group[i]), int(group[at])) for i in left[near]]
            front, left = np.concatenate([front, left[near]]), left[~near]
    return edges


def spread(nodes: DataFrame) -> DataFrame:
    """The fingerprints in as many partitions as shuffles have: few bytes become many rows behind this. By a hash, as Spark
    leaves out a shuffle by the column that rows were made distinct by."""
    return nodes.repartition(fan_out(nodes.sparkSession), F.xxhash64("_fp"))


def links(nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """For distinct ``_fp``: edges ``u``, ``v`` that connect all within ``threshold`` (1 or 2) bits of each other.

    A group of two, which most are, is compared in the JVM; larger ones in batches of groups in Python."""
    at = spread(nodes).select("_fp", F.explode(anchors(F.col("_fp"), 1 + (threshold + 1) // 2)).alias("_anchor"))
    groups = at.groupBy("_anchor").agg(F.count("*").alias("_n"), F.min("_fp").alias("_a"), F.max("_fp").alias("_b"), F.collect_set("_fp").alias("_all"))
    groups = cut(groups.where("_n > 1"))
    near = F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= threshold
    pairs = groups.where((F.col("_n") == 2) & near).select(F.col("_b").alias("u"), F.col("_a").alias("v"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            edges = [e for g in frame["_all"] for e in _joined(np.asarray(g, np.int64), threshold)]
            yield pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    many = groups.where("_n > 2").select("_all").mapInPandas(compare, "u long, v long")
    return pairs.union(many).distinct()


def _named(rows: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """``rows`` (with ``_id``) and the ``_root`` of their node's component, and ``_component``, the smallest id in it."""
    nodes = cut(rows.groupBy(node).agg(F.min("_id").alias("_low")))
    roots = cut(components(edges))
    linked = nodes.join(roots, nodes[node] == roots["node"], "left").withColumn("_root", F.coalesce("root", node))
    lows = linked.groupBy("_root").agg(F.min("_low").alias("_component"))
    return rows.join(linked.select(node, "_root").join(lows, "_root"), node)


def near_duplicates(docs: DataFrame, threshold: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_hash``, ``_fp``, ``_root`` and ``_component``, the smallest id reachable over links, for each row."""
    prints = cut(fingerprints(docs, width, id_col, text_col))
    return _named(prints, "_fp", links(prints.select("_fp").distinct(), threshold))


# Near-copies by similarity. At a similarity of 0.8 the fingerprints of whole texts differ in about ten of 64 bits, and
# to cover that each would have to go to millions of anchors. So beside the covering, which links fingerprints within a
# threshold, texts meet by MinHash samples, the shingles that come first in each of several orders. Two such samples are
# equal with probability similarity ** SAMPLE.
# Samples of short texts differ more often, so these meet by all the shingles of a prefix, which misses none.

#: Five words a shingle; orders, and shingles sampled in each: of pairs at 0.8, 0.2 % share no sample.
COPY_WIDTH, ORDERS, SAMPLE = 5, 12, 4
#: A pair is found exactly if one of its texts has fewer shingles than this.
SHORT = 60
#: Texts compared in one group; larger groups are dealt into such parts, and every two parts are compared.
GROUP = 2048
#: Shingles in such a part, about (a single longer text is a part).
PART_SHINGLES = 1 << 21
MULTIPLIERS = [(xxhash.xxh64_intdigest(str(k).encode(), SEED) | 1) for k in range(ORDERS)]


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    parts = [np.unique(p) for p in shingle_hashes(text, COPY_WIDTH)] or [np.zeros(0, np.uint64)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def copy_samples(hashes: np.ndarray) -> list[int]:
    """The SimHash of each order's sample of a text's shingles."""
    samples = []
    for m in MULTIPLIERS if len(hashes) else []:
        order = hashes * np.uint64(m)
        first = hashes[np.argpartition(order, SAMPLE - 1)[:SAMPLE]] if len(hashes) > SAMPLE else hashes
        samples.append(int(np.packbits(2 * bit_votes(first) > len(first)).view(">i8")[0]))
    return samples


def _spanning(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that connect all similar texts of a group. A text is compared to those that nothing has reached yet, by
    whole shingle sets; of those only the ones whose numbers of shingles allow the similarity."""
    by_size = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets = [int(ids[i]) for i in by_size], [sets[i] for i in by_size]
    n = np.array([len(s) for s in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own, marked = np.split(flat, np.cumsum(n)[:-1]), np.zeros(len(values), np.int32)
    left, edges = np.arange(len(ids)), []
    while len(left):
        front, flat, left = [int(left[0])], flat[n[left[0]] :], left[1:]
        sizes, ends = n[left], np.cumsum(n[left])
        while front and len(left):
            at = front.pop()
            lo, hi = np.searchsorted(sizes, [n[at] * similarity - 1e-6, n[at] / similarity + 1e-6])
            if lo == hi:
                continue
            starts = ends[lo:hi] - sizes[lo:hi]
            marked[own[at]] = 1
            shared = np.add.reduceat(marked[flat[starts[0] : ends[hi - 1]]], starts - starts[0])
            marked[own[at]] = 0
            hit = np.zeros(len(left), bool)
            hit[lo:hi] = shared / (sizes[lo:hi] + n[at] - shared) >= similarity
            if hit.any():
                edges += [(ids[i], ids[at]) for i in left[hit]]
                front += left[hit].tolist()
                flat, left = flat[np.repeat(~hit, sizes)], left[~hit]
                sizes, ends = n[left], np.cumsum(n[left])
    return edges


def blocks(met: DataFrame) -> DataFrame:
    """``uid``, ``key``, ``i``, ``j`` for the members of keys of ``size`` with ``weight`` shingles: a large key's are dealt
    into parts of about GROUP texts and PART_SHINGLES shingles, and every two parts meet in a block, so that all pairs of a key do. Each key is dealt in its own way."""
    parts = F.least("size", F.greatest(F.ceil(F.col("size") / GROUP), F.ceil(F.col("weight") / PART_SHINGLES))).cast("int")
    dealt = met.select("uid", "key", parts.alias("parts"), F.pmod(F.xxhash64("uid", "key"), parts).cast("int").alias("part"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: (o != F.col("part")) | (F.col("parts") == 1))
    pairs = dealt.select("uid", "key", "part", F.explode(others).alias("other"))
    return pairs.select("uid", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def prefixes(made: DataFrame, similarity: float) -> DataFrame:
    """``uid``, ``n``, ``key`` for ``shingles`` of texts: in one order of all shingles, rare ones first, two similar texts
    share one of the first n - ceil(similarity * n) + 1 of each. Those that no other text has come first of all."""
    each = made.select("uid", "n", F.explode("shingles").alias("shingle"))
    seen = each.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1")
    known = each.join(seen, "shingle").groupBy("uid").agg(F.min("n").alias("n"), F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("known"))
    own = F.col("n") - F.size("known")
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    taken = F.slice("known", F.lit(1), F.greatest(first - own, F.lit(0)).cast("int"))
    return known.select("uid", "n", F.explode(taken).alias("at")).select("uid", "n", F.xxhash64(F.lit("prefix"), "at.shingle").alias("key"))


def copy_links(made: DataFrame, texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """For ``uid``, ``n``, ``samples``, ``shingles`` of distinct texts with words, and ``uid``, ``text`` of at least these:
    edges ``u``, ``v`` that connect similar ones. The texts that meet another are shingled again to be compared."""
    at = made.select("uid", "n", F.posexplode("samples").alias("order", "sample"))
    at = cut(at.select("uid", "n", F.xxhash64("order", "sample").alias("key")).union(prefixes(made, similarity)))
    shared = at.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1")
    met = at.join(shared, "key")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        uids = group["uid"].to_numpy()
        edges = _spanning(np.arange(len(uids)), [shingle_set(t) for t in group["text"]], similarity)
        return pd.DataFrame([(uids[a], uids[b]) for a, b in edges], columns=["u", "v"], dtype=object)

    # the same texts often meet under several keys: a set of members is compared once
    sets = blocks(met).groupBy("key", "i", "j").agg(F.sort_array(F.collect_set("uid")).alias("uids")).where("size(uids) > 1")
    sets = sets.select(F.md5(F.array_join("uids", "")).alias("set"), "uids").dropDuplicates(["set"]).select("set", F.explode("uids").alias("uid"))
    members = cut(sets).join(texts.dropDuplicates(["uid"]), "uid")
    return members.groupBy("set").applyInPandas(compare, "u string, v string").distinct()


def anchor_links(made: DataFrame, threshold: int) -> DataFrame:
    """For ``uid``, ``fp`` of distinct texts: edges ``u``, ``v`` that connect all whose fingerprints are equal or, by their
    anchors, within ``threshold`` bits of each other."""
    first = cut(made.groupBy("fp").agg(F.min("uid").alias("low")))
    equal = made.join(first, "fp").where("uid <> low").select(F.col("uid").alias("u"), F.col("low").alias("v"))
    pairs = cut(links(first.select(F.col("fp").alias("_fp")), threshold))
    one, other = (first.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")) for c in ("u", "v"))
    return equal.union(pairs.join(one, "u").join(other, "v").select(F.col("low_u").alias("u"), F.col("low_v").alias("v")))


def near_copies(docs: DataFrame, similarity: float = 0.8, threshold: int | None = None, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_hash``, ``_root`` and ``_component`` for each row: equal texts, and those whose five-word shingles have
    a Jaccard similarity of ``similarity`` or more, are linked. Texts without words are linked to each other. With a
    ``threshold`` (1 or 2) so are texts with SimHash fingerprints that many bits apart at most, as by ``near_duplicates``."""
    rows = docs.select(F.col(id_col).alias("_id"), identity(text_col).alias("_hash"))
    texts = docs.select(identity(text_col).alias("uid"), F.col(text_col).alias("text"))

    def samples(frame: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = frame["text"].to_pylist()
        sets = [shingle_set(t) for t in texts]
        whole = [copy_samples(s) if len(s) >= SHORT else [] for s in sets]
        short = [s.view(np.int64) if len(s) * similarity < SHORT else [] for s in sets]
        lists = {c: pa.array(v, pa.list_(pa.int64())) for c, v in (("samples", whole), ("shingles", short))}
        fp = [fingerprint(t, width) if threshold else None for t in texts]
        return {"uid": frame["uid"], "n": pa.array(map(len, sets), pa.int64()), "fp": pa.array(fp, pa.int64())} | lists

    made = by_batch(texts, lambda: samples, "uid string, n long, fp long, samples array<long>, shingles array<long>")
    made = cut(made.dropDuplicates(["uid"]))
    blank = made.where("n = 0").agg(F.min("uid")).first()[0]
    edges = made.where("n = 0").select(F.col("uid").alias("u"), F.lit(blank).cast("string").alias("v")).where("u <> v")
    if threshold:
        edges = edges.union(anchor_links(made.select("uid", "fp"), threshold))
    return _named(rows, "_hash", copy_links(made.where("n > 0"), texts, similarity).union(edges))


def keep_one(docs: DataFrame, found: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row left of each component of ``found`` (``near_copies``): that with its smallest id. Where no
    row of a component has an id, one stays."""
    found = near_copies(docs, id_col=id_col, text_col=text_col) if found is None else found
    named = found.where(F.col("_id") == F.col("_component")).groupBy("_id", "_root").agg(F.min("_hash").alias("_hash"))
    nameless = found.where("_component is null").groupBy("_root").agg(F.min("_hash").alias("_hash")).select(F.lit(None).alias("_id"), "_hash")
    mark = lambda c: [F.coalesce(c.cast("string"), F.lit("")).alias("_k"), c.isNull().alias("_n")]
    kept = named.select("_id", "_hash").union(nameless).select(*mark(F.col("_id")), "_hash")
    marked = packed(docs, _id=F.col(id_col), _hash=identity(text_col)).select("_doc", *mark(F.col("_id")), "_hash")
    equal = Window.partitionBy("_k", "_n", "_hash").orderBy("_hash")
    one = marked.join(kept, ["_k", "_n", "_hash"], "left_semi").withColumn("_row", F.row_number().over(equal)).where("_row = 1")
    return one.select("_doc.*")


def op10_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id")
    )
