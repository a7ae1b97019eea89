"""Benchmark decontamination.

A benchmark item is looked for in every window of its own number of words. A
window and an item are similar if the weighted Jaccard similarity of their
five-word shingles (weights: how often a shingle stands there) is at least 0.8.
Windows get a SimHash, and items stand in a multi-index: a row for each of four blocks of 16
bits and each value within a quarter of the radius (rounded down) of the item's
block. Of two fingerprints within the radius at least one block is within a
quarter of it, so a join of windows and index by block and value finds all of them;
those within the radius on all bits are candidates, which are verified exactly.
Of unlike windows and items of one length the join meets about one in 26 a block.

Similar windows share eight ninths of their shingles with the item at least. So
the texts are read once, against a bit table of the benchmark's shingles (with
the lengths of the items that hold them), and only windows of an item's length
that hold so many known ones are fingerprinted; runs of such windows that are equal
in several documents are judged once. The bit table has at most ``TABLE_BITS``
bits, whatever the number of items; where it is too small it lets more windows
through, and nothing is missed. Items are never collected.

Edge cases: words are runs of letters and digits, lower-cased; items of less
than five words are one shingle and must be there as they are; items without
words and null items match nothing; a text shorter than an item is one window;
equal items are found each; a null text has no words; repeated rows are found
each; ids may have any type; other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, cut, fan_out, identity, packed

WIDTH, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 two fingerprints differ in 9.7 bits on average, with a deviation of 2.9: the radius keeps 999 of 1,000.
RADIUS, BLOCKS = 19, 4
REMEMBERED = 1 << 18
#: Windows in a run, at most.
PART = 1 << 12
#: Bits of the table of known shingles for each entry; and in all, at most.
ENTRY_BITS, TABLE_BITS = 64, 1 << 29
NOT_WORD = re.compile(r"[\W_]+")
#: Odd multipliers of a shingle's words, and of the last mixing (fixed values of splitmix64).
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: All values of a block that differ from zero in a quarter of the radius at most.
NEAR = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(64 // BLOCKS), n)]


def words_of(text: str | None) -> list[str]:
    return [p for raw in (text or "").lower().split() for p in ([raw] if raw.isalnum() else NOT_WORD.split(raw)) if p]


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * MIX_1
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(30))) * MIX_2
    return out ^ (out >> np.uint64(31))


def prints(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the ``length`` shingles from each start on."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    votes = sums[starts + length] - sums[starts]
    return np.packbits(2 * votes > length, axis=1).view(">u8").ravel().astype(np.uint64)


def similarity(a: list[int], b: list[int]) -> float:
    """Weighted Jaccard similarity of two lists of shingles."""
    x, y = Counter(a), Counter(b)
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class Hashes(dict):
    """From a raw word to the hashes of its parts; forgets all when it has grown too large."""

    def __missing__(self, raw: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = out = tuple(map(word_hash, [raw] if raw.isalnum() else filter(None, NOT_WORD.split(raw))))
        return out

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, (text or "").lower().split())), np.uint64)


class Table:
    """A bounded table of bits: whether a number may have been put in."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words) * 64 - 1).bit_length())

    @staticmethod
    def size(entries: int) -> int:
        """Words of 64 bits, a power of two."""
        return max(1 << 10, min(TABLE_BITS // 64, 1 << (entries * ENTRY_BITS // 64).bit_length()))

    def places(self, numbers: np.ndarray) -> Iterator[np.ndarray]:
        yield numbers >> self.shift
        yield (numbers * MIX_1) >> self.shift

    def known(self, numbers: np.ndarray) -> np.ndarray:
        out = np.ones(len(numbers), bool)
        for at in self.places(numbers):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def digest(grams: np.ndarray, width: int, length: int) -> str:
    """128 bits for shingles and the widths and lengths that they are compared by."""
    return hashlib.blake2b(grams.tobytes() + b"%d,%d" % (width, length), digest_size=16).hexdigest()


def with_length(grams: np.ndarray, length: int) -> np.ndarray:
    """Other numbers for the same shingles in items of a length."""
    return (grams ^ np.uint64(length * 2 + 1)) * MIX_2


def needed(own: int, here: int) -> int:
    """How many shingles an item and a window must share to be similar."""
    return int(np.ceil(SIMILARITY * (own + here) / (1 + SIMILARITY) - 1e-9))


def runs(hashes: np.ndarray, sizes: list[tuple[int, int]], table: Table | None) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """For (width, length) of the items: width, length, place of the first window and the shingles of each run of windows,
    one after the other, that hold enough known shingles (all windows without a table)."""
    grams: dict[int, tuple] = {}
    for width, length in sizes:
        if width not in grams:
            all_of = shingles(hashes, width)
            at = np.flatnonzero(table.known(all_of)) if table else np.arange(len(all_of))
            grams[width] = all_of, at
        here, at = grams[width]
        n = min(length, len(here))
        need = needed(length, n)
        if not len(here) or len(at) < need:
            continue
        flags = np.zeros(len(here) + 1, np.int32)
        flags[at + 1] = table.known(with_length(here[at], length)) if table else 1
        seen = np.cumsum(flags)
        starts = np.flatnonzero(seen[n:] - seen[:-n] >= need)
        if len(starts):
            for some in np.split(starts, np.flatnonzero((np.diff(starts) > 1) | (np.arange(1, len(starts)) % PART == 0)) + 1):
                yield width, length, int(some[0]), here[some[0] : some[-1] + n]


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.int64), *(a.view(np.int64) for a in arrays)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]), pa.int32()), pa.array(flat, pa.int64()))


def _items(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``content`` (128 bits for its shingles), ``width``, ``length``, ``own`` and ``fp``."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def read(frame: pa.RecordBatch) -> dict[str, pa.Array]:
        hashes = [Hashes().of(t) for t in frame["text"].to_pylist()]
        at = [i for i, h in enumerate(hashes) if len(h)]
        own = [shingles(hashes[i], min(WIDTH, len(hashes[i]))) for i in at]
        return {
            "item_id": frame["item_id"].take(pa.array(at, pa.int64())),
            "content": pa.array([digest(o, min(WIDTH, len(hashes[i])), len(o)) for i, o in zip(at, own, strict=True)], pa.string()),
            "width": pa.array([min(WIDTH, len(hashes[i])) for i in at], pa.int64()),
            "length": pa.array([len(o) for o in own], pa.int64()),
            "own": _longs(own),
            "fp": pa.array([int(prints(o, np.array([0]), len(o)).view(np.int64)[0]) for o in own], pa.int64()),
        }

    texts = benchmark.where("text is not null").select("item_id", "text")
    return cut(by_batch(texts, lambda: read, f"item_id {kind}, content string, width long, length long, own array<long>, fp long"))


def _table(contents: DataFrame, entries: int) -> np.ndarray:
    """The bits of all shingles of items, and of them with the item's length; made in parts, which have a bounded size together."""
    size = Table.size(entries)

    def bits(frame: pa.RecordBatch) -> dict[str, pa.Array]:
        words = np.zeros(size, np.uint64)
        table = Table(words)
        for length, own in zip(frame["length"].to_pylist(), frame["own"].to_pylist(), strict=True):
            grams = np.array(own, np.int64).view(np.uint64)
            for numbers in (grams, with_length(grams, length)):
                for at in table.places(numbers):
                    np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        return {"at": pa.array(used, pa.int64()), "bits": pa.array(words[used].view(np.int64), pa.int64())}

    made = by_batch(contents.select("length", "own"), lambda: bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size, np.int64)
    words[made["at"].to_numpy()] = made["bits"].to_numpy()
    return words.view(np.uint64)


def _places(docs: DataFrame, sizes: list[tuple[int, int]], words: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    """A row for each run of windows of a text that may be similar to an item."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((sizes, words))

    def search():
        sizes, words = shared.value
        table, hashes = None if words is None else Table(words), Hashes()

        def do(frame: pa.RecordBatch) -> dict[str, pa.Array]:
            found = [(i, *run) for i, t in enumerate(frame["_text"].to_pylist()) for run in runs(hashes.of(t), sizes, table)]
            at = pa.array([f[0] for f in found], pa.int64())
            out = {c: frame[c].take(at) for c in ("_id", "_hash", "_row")}
            out |= {c: pa.array([f[k] for f in found], pa.int64()) for k, c in ((1, "width"), (2, "length"), (3, "first"))}
            return out | {"run": pa.array([digest(f[4], f[1], f[2]) for f in found], pa.string()), "grams": _longs([f[4] for f in found])}

        return do

    texts = docs.select(F.col(id_col).alias("_id"), identity(text_col).alias("_hash"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"))
    return cut(by_batch(texts, search, f"_id {kind}, _hash string, _row long, width long, length long, first long, run string, grams array<long>"))


def _windows(different: DataFrame) -> DataFrame:
    """``run``, ``width``, ``length``, ``at`` and ``fp`` of each window of the runs."""

    def fingerprint(frame: pa.RecordBatch) -> dict[str, pa.Array]:
        out: list[tuple] = []
        for run, width, length, grams in zip(*(frame[c].to_pylist() for c in ("run", "width", "length", "grams")), strict=True):
            here = np.array(grams, np.int64).view(np.uint64)
            n = min(length, len(here))
            starts = np.arange(len(here) - n + 1)
            out += [(run, width, length, s, p) for s, p in zip(starts.tolist(), prints(here, starts, n).view(np.int64).tolist(), strict=True)]
        return {c: pa.array([o[k] for o in out], pa.string() if c == "run" else pa.int64()) for k, c in enumerate(("run", "width", "length", "at", "fp"))}

    return by_batch(different, lambda: fingerprint, "run string, width long, length long, at long, fp long")


def lookups(windows: DataFrame, contents: DataFrame) -> DataFrame:
    """The windows and items' fingerprints (``item_fp``) of one width and length that have a block in common, near enough; a row
    for each such block.

    Spark takes the index for as small as the items it is made of, and would send all of it to the driver to broadcast it; so
    the join is said to be one of sorted sides. The index holds fingerprints only, as its rows are many."""
    size = 64 // BLOCKS
    block = lambda k: F.expr(f"shiftrightunsigned(fp, {k * size})").bitwiseAND(F.lit((1 << size) - 1))
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), block(k).alias("value")) for k in range(BLOCKS)])
    items = contents.select("width", "length", "fp").distinct().repartition(fan_out(contents.sparkSession), F.xxhash64("fp"))
    index = items.select("width", "length", F.col("fp").alias("item_fp"), F.explode(blocks).alias("b"))
    near = F.explode(F.expr(f"array({', '.join(f'{v}L' for v in NEAR)})"))
    index = index.select("width", "length", "item_fp", F.col("b.block").alias("block"), "b.value", near.alias("change"))
    index = index.select("width", "length", "item_fp", "block", F.col("value").bitwiseXOR(F.col("change")).alias("value"))
    asked = windows.select("run", "width", "length", "at", "fp", F.explode(blocks).alias("b")).select("run", "width", "length", "at", "fp", "b.block", "b.value")
    return asked.join(index.hint("merge"), ["width", "length", "block", "value"])


def candidates(windows: DataFrame, contents: DataFrame) -> DataFrame:
    """``run``, ``content``, ``at`` for all windows and contents of one width and length with fingerprints within the radius."""
    met = lookups(windows, contents).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    met = met.select("run", "at", "width", "length", "item_fp").distinct()
    named = contents.select("content", "width", "length", F.col("fp").alias("item_fp"))
    return met.join(named, ["width", "length", "item_fp"]).select("run", "content", "at")


def _verified(found: DataFrame, different: DataFrame, contents: DataFrame) -> DataFrame:
    """``run``, ``content``, ``similarity``, ``at`` of the best window of each run for each content, if it is similar."""
    pairs = found.groupBy("run", "content").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    pairs = pairs.join(different.select("run", "grams"), "run").join(contents.select("content", "own"), "content")

    def verify(frame: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for run, content, ats, grams, own in zip(*(frame[c].to_pylist() for c in ("run", "content", "ats", "grams", "own")), strict=True):
            n = min(len(own), len(grams))
            best = max((similarity(grams[a : a + n], own), -a) for a in ats)
            if best[0] >= SIMILARITY:
                out.append((run, content, best[0], -best[1]))
        kinds = (("run", pa.string()), ("content", pa.string()), ("similarity", pa.float64()), ("at", pa.int64()))
        return {c: pa.array([o[k] for o in out], t) for k, (c, t) in enumerate(kinds)}

    return by_batch(pairs, lambda: verify, "run string, content string, similarity double, at long")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: bool = True) -> DataFrame:
    """``_id``, ``_hash`` (MD5 of the text), ``item_id``, ``similarity``, ``first_word``, ``n_words``. Without ``table`` all
    windows are fingerprinted, which is slow."""
    items = _items(benchmark)
    contents = items.drop("item_id").dropDuplicates(["content"])
    # one row for each number of words that items have
    sizes = sorted((r["width"], r["length"]) for r in items.select("width", "length").distinct().collect())
    words = _table(contents, 2 * int(items.agg(F.sum("length")).first()[0] or 0)) if table and sizes else None
    places = _places(docs, sizes, words, id_col, text_col)
    different = places.select("run", "width", "length", "grams").dropDuplicates(["run"])
    best = _verified(candidates(_windows(different), contents), different, contents)
    size = F.least("length", F.size("grams")) + F.col("width") - 1
    found = places.select("_id", "_hash", "_row", "first", size.alias("n_words"), "run").join(best, "run")
    found = found.select("_row", "content", F.struct("similarity", (-F.col("first") - F.col("at")).alias("back"), "n_words", "_id", "_hash").alias("m"))
    found = found.groupBy("_row", "content").agg(F.max_by("m", F.struct("m.similarity", "m.back")).alias("m"))
    named = found.join(items.select("content", "item_id"), "content")
    return named.select("m._id", "m._hash", "item_id", "m.similarity", (-F.col("m.back")).alias("first_word"), "m.n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    bad = matches(docs, benchmark, text_col=text_col, **options).select("_hash").distinct()
    return packed(docs, _hash=identity(text_col)).join(bad, "_hash", "left_anti").select("_doc.*")


def op6_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark).select(F.col("_id").alias("doc_id"), "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_words")
