"""Collocation mining by SON partitioning.

A phrase with a support of s over a corpus has, in at least one shard of it, at
least the shard's share of s. So each shard is mined completely at that lowered
support, the phrases that are frequent in any shard are candidates, and the
candidates are counted exactly over all shards.

- Words are counted first, exactly. A phrase needs frequent words only, and a bit
  table tells tasks which words may be frequent.
- Mining: ``SHARDS`` shards, to which texts are dealt by hash, each mined by many
  tasks. A task gives hashes of phrases with their counts; Spark adds them up by
  shard, and those with their share of the support are put into a bit table:
  first pairs of words, then longer phrases whose pairs are all in the first one.
  The support is a fixed number, so shards must be few: with as many shards as
  tasks the lowered support would be less than one, and every phrase a candidate.
- Counting: tasks give the texts of phrases that may be candidates, with their
  counts; Spark adds them up, and those below the support go.

Hashes and bit tables only ever let more phrases through, so the result is exact.
Bit tables have at most ``TABLE_BITS`` bits, whatever the corpus. Texts are
handled as bytes, all of one language in a batch together: a line's end parts
pieces, as between two texts.

Cuts look the parts' counts up by joins; contained phrases meet longer ones by
their own text; the first of each language are found by a range sort and the
numbers of rows in its parts, so no language is ranked in one task.

Edge cases: a null text is empty; a null language is ``und``, together with texts
in a language of that name; texts of any length are parted between pieces; equal
rows each count; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fan_out
from .decontamination import MIX_1, MIX_2, Table

SHARDS = 4
LONGEST, SUPPORT, TOP = 4, 30, 2000
#: A phrase is part of a longer one if that has so many hundredths of its occurrences.
PART_OF = 80
#: Bytes of text that are handled together, more only for a longer piece.
CHUNK = 1 << 19
#: Hashes that a task adds up before it gives them on.
GATHERED = 1 << 20
#: Texts that are taken out of a batch together.
TOGETHER = 1024
#: Languages that are broadcast with their numbers of words; more are joined.
FEW_LANGUAGES = 10_000

_PIECE = re.compile(rb"[.,;:!?\x0a-\x0d]")
_KINDS = np.zeros(256, np.uint8)
_KINDS[[32, 9]] = 1
_KINDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
#: The base of the hash of bytes, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.where(np.arange(n) > 0, np.uint64(b), np.uint64(1)), dtype=np.uint64) for b in (_BASE, _BACK))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


class Pieces:
    """Words of some text, in order, with the piece each is in. ``text``: the words with one space between them."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + b"\n", np.uint8)
        kinds = _KINDS[raw]
        word = kinds == 0
        edge = np.diff(np.concatenate([[False], word]).astype(np.int8))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kinds == 2)[begins]
        self.letters = raw[word]
        self.sizes = ends - begins
        after = word.copy()
        after[ends] = True
        self.text = raw[after]
        self.start = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1].astype(np.int64)
        self.text[self.start + self.sizes] = 32

    def words(self) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer(ends), pa.py_buffer(self.letters)])

    def hashes(self, powers: Powers, salt: int) -> None:
        """Makes ready for ``hashed``."""
        powers.reach(len(self.text) + 1)
        self.sums = np.zeros(len(self.text) + 1, np.uint64)
        np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * powers.up[: len(self.text)], out=self.sums[1:])
        self.powers, self.salt = powers, np.uint64(salt)

    def hashed(self, first: np.ndarray, n: int) -> np.ndarray:
        """A hash of the ``n`` words from each first one on."""
        begin = self.start[first]
        end = self.start[first + n - 1] + self.sizes[first + n - 1]
        return mixed((self.sums[end] - self.sums[begin]) * self.powers.down[begin] ^ self.salt)

    def runs(self, n: int, words: Table, pairs: Table | None) -> np.ndarray:
        """First words of all phrases of ``n`` words in one piece whose words, and pairs of words, are all known."""
        last = len(self.piece) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64)
        fine = self.piece[:last] == self.piece[n - 1 :]
        known = words.known(self.hashed(np.arange(len(self.piece)), 1))
        for k in range(n):
            fine &= known[k : k + last]
        first = np.flatnonzero(fine)
        for k in range(n - 1 if pairs is not None else 0):
            first = first[pairs.known(self.hashed(first + k, 2))]
        return first

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        begin = self.start[first]
        size = self.start[first + n - 1] + self.sizes[first + n - 1] - begin
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.text[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def chunks(texts: list[bytes]) -> Iterator[bytes]:
    """The texts, joined or parted between pieces."""
    held, size = [], 0
    for text in texts:
        while len(text) > 2 * CHUNK and (end := _PIECE.search(text, CHUNK)):
            yield text[: end.start()]
            text = text[end.start() :]
        held.append(text)
        size += len(text) + 1
        if size > CHUNK:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def by_language(frame: pa.RecordBatch) -> Iterator[tuple[str, int, Pieces]]:
    """The pieces of a batch's texts, of one language and shard at a time."""
    langs, shards = frame["_lang"], frame["_shard"]
    for lang, shard in sorted(set(zip(langs.to_pylist(), shards.to_pylist(), strict=True))):
        places = pc.indices_nonzero(pc.and_(pc.equal(langs, lang), pc.equal(shards, shard)))
        for at in range(0, len(places), TOGETHER):
            texts = pc.ascii_lower(frame["_text"].take(places[at : at + TOGETHER])).cast(pa.large_binary())
            for data in chunks(texts.to_pylist()):
                yield lang, shard, Pieces(data)


def _texts(docs: DataFrame, text_col: str, lang_col: str, shards: int) -> DataFrame:
    """Each text with its language and its shard, which goes by the text, so that all passes deal alike."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    shard = F.pmod(F.xxhash64(text), F.lit(shards)).cast("int")
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("_lang"), text.alias("_text"), shard.alias("_shard")).where("_text <> ''")


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``shard``, ``word``, ``n`` of all words (without a shard), and of each language in each shard (without a
    word)."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            held: dict[str, list[pa.Array]] = defaultdict(list)
            sizes: dict[tuple[str, int], int] = defaultdict(int)
            for lang, shard, pieces in by_language(frame):
                held[lang].append(pieces.words())
                sizes[lang, shard] += len(pieces.sizes)
            for lang, words in held.items():
                found = pc.value_counts(pa.chunked_array(words))
                n = found.field("counts").cast(pa.int64())
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()), "shard": pa.nulls(len(n), pa.int32()), "word": found.field("values"), "n": n})
            langs, shards = [x for x, _ in sizes], [x for _, x in sizes]
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "shard": pa.array(shards, pa.int32()), "word": pa.nulls(len(langs), pa.binary()), "n": pa.array(list(sizes.values()), pa.int64())})

    made = texts.mapInArrow(count, "lang string, shard int, word binary, n long")
    return made.groupBy("lang", "shard", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def salts(lang: str) -> int:
    """A number that keeps the hashes of languages apart."""
    return sum((b + 1) * pow(_BASE, i + 1, 1 << 64) for i, b in enumerate(lang.encode("utf-8", "surrogatepass"))) % (1 << 64)


def bit_table(df: DataFrame, hashes) -> np.ndarray:
    """The bits of all ``hashes`` (of a batch) of the frame, in a table of bounded size."""
    words = Table.size(df.count())

    def bits(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, table = np.zeros(words, np.uint64), Table(np.zeros(words, np.uint64))
        for frame in frames:
            for at in table.places(hashes(frame)):
                np.bitwise_or.at(part, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(part)
        yield pa.RecordBatch.from_pydict({"at": pa.array(used, pa.int64()), "bits": pa.array(part[used].view(np.int64), pa.int64())})

    made = df.mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[made["at"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
    return out


def _word_hashes(frame: pa.RecordBatch) -> np.ndarray:
    """Hashes of words as ``Pieces`` makes them."""
    out, powers = [np.zeros(0, np.uint64)], Powers()
    for lang, words in _grouped(frame["lang"].to_pylist(), frame["word"].to_pylist()):
        pieces = Pieces("\n".join(words).encode("utf-8", "surrogatepass"))
        pieces.hashes(powers, salts(lang))
        out.append(pieces.hashed(np.arange(len(pieces.sizes)), 1))
    return np.concatenate(out)


def _grouped(keys: list, values: list) -> Iterator[tuple]:
    groups = defaultdict(list)
    for k, v in zip(keys, values, strict=True):
        groups[k].append(v)
    return iter(groups.items())


def added(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes and the sums of their counts."""
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def cell(lang: str) -> int:
    """Four bytes for a language. Languages that share them share their shards' parts of the support, which then still
    make one whole."""
    return zlib.crc32(lang.encode("utf-8", "surrogatepass")) - (1 << 31)


def local_counts(texts: DataFrame, sizes: tuple[int, ...], words: np.ndarray, pairs: np.ndarray | None = None) -> DataFrame:
    """``cell``, ``shard``, ``hash``, ``n`` of all phrases of so many known words, whose pairs of words are all known."""
    shared = texts.sparkSession.sparkContext.broadcast((words, pairs))

    def mine(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        known, fine_pairs, powers = Table(words), None if pairs is None else Table(pairs), Powers()
        held: dict[tuple[int, int], tuple[list, list]] = defaultdict(lambda: ([], []))
        gathered = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (c, shard), (h, n) in held.items():
                h, n = added(h, n)
                same = lambda x, h=h: pa.array(np.full(len(h), x, np.int32))
                yield pa.RecordBatch.from_pydict({"cell": same(c), "shard": same(shard), "hash": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64())})

        for frame in frames:
            for lang, shard, pieces in by_language(frame):
                pieces.hashes(powers, salts(lang))
                found = [pieces.hashed(pieces.runs(k, known, fine_pairs), k) for k in sizes]
                h, n = added(found, [np.ones(len(x), np.int64) for x in found])
                group = held[cell(lang), shard]
                group[0].append(h)
                group[1].append(n)
                gathered += len(h)
                if gathered > GATHERED:
                    yield from out()
                    held.clear()
                    gathered = 0
        yield from out()

    made = texts.mapInArrow(mine, "cell int, shard int, hash long, n long")
    return made.groupBy("cell", "shard", "hash").agg(F.sum("n").alias("n"))


def few(df: DataFrame) -> DataFrame:
    """A frame with a row for each language (and shard), broadcast if counted as small."""
    return F.broadcast(df) if df.count() <= FEW_LANGUAGES else df


def locally_frequent(local: DataFrame, parts: DataFrame, support: int) -> DataFrame:
    """``hash`` of the phrases that have, in a shard, at least the shard's share of the support. ``parts``: cell, shard,
    of_shard and of_all, the numbers of words."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    met = local.join(parts, ["cell", "shard"]).where(wide("n") * wide("of_all") >= wide("of_shard") * F.lit(support))
    return met.select("hash").distinct()


def phrase_counts(texts: DataFrame, words: np.ndarray, pairs: np.ndarray, wanted: np.ndarray, longest: int) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and ``a`` of all phrases that may be candidates; counts are exact."""
    shared = texts.sparkSession.sparkContext.broadcast((words, pairs, wanted))

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fine_pairs, asked, powers = *map(Table, shared.value), Powers()
        for frame in frames:
            for lang, _, pieces in by_language(frame):
                pieces.hashes(powers, salts(lang))
                for k in range(2, longest + 1):
                    first = pieces.runs(k, known, fine_pairs)
                    first = first if k == 2 else first[asked.known(pieces.hashed(first, k))]
                    found = pc.value_counts(pieces.phrases(first, k))
                    n = found.field("counts").cast(pa.int64())
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()), "phrase": found.field("values").cast(pa.binary()), "words": pa.array(np.full(len(n), k), pa.int32()), "n": n})

    made = texts.mapInArrow(count, "lang string, phrase binary, words int, n long")
    return made.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "words").agg(F.sum("n").alias("a"))


def _slice(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("parts", first, n), " ")


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``a``, ``l``, ``r``, ``n``, ``score`` of the phrases of two words and more, by the
    cut that scores lowest. ``frequent``: lang, phrase, words, a of all frequent words and phrases."""
    long = frequent.where("words > 1").withColumn("parts", F.split("phrase", " "))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _slice(F.lit(1), F.col("k")).alias("left"), _slice(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    counts = lambda text, n: frequent.select("lang", F.col("phrase").alias(text), F.col("a").alias(n))
    cuts = cuts.join(counts("left", "l"), ["lang", "left"]).join(counts("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("cast(a as decimal(38,0)) * 2000000 div (cast(l as decimal(38,0)) + r)"))
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.join(totals, "lang").select("lang", "phrase", "words", "a", "c.l", "c.r", "n", "c.score")


def contained(frequent: DataFrame, part_of: int) -> DataFrame:
    """``lang`` and ``phrase`` of those that stand in a longer frequent phrase with enough of their occurrences."""
    long = frequent.where("words > 2").withColumn("parts", F.split("phrase", " "))
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: _slice(i, n))))
    parts = long.select("lang", F.explode(F.array_distinct(places)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    met = frequent.where("words > 1").select("lang", "phrase", "a").join(parts, ["lang", "phrase"])
    return met.where(wide("longer") * 100 >= wide("a") * part_of).select("lang", "phrase")


def first_of_each(df: DataFrame, key: str, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each key, with their ``rank``: a range sort deals all rows, and the numbers of rows in
    the parts before give a row's place."""

    def number(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for frame in frames:
            keys, places = frame["_key"].to_pylist(), []
            for k in keys:
                seen[k] += 1
                places.append(seen[k])
            yield pa.RecordBatch.from_pydict({"_row": frame["_row"], "_key": frame["_key"], "_part": pa.array(np.full(len(keys), part), pa.int32()), "_place": pa.array(places, pa.int64())})

    rows = df.repartitionByRange(fan_out(df.sparkSession), F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    rows = rows.select(F.struct("*").alias("_row"), F.col(key).alias("_key"))
    numbered = cut(rows.mapInArrow(number, T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_place", T.LongType())])))
    parts = numbered.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < top).drop("_n")
    near = numbered.where(F.col("_place") <= top).join(parts, ["_key", "_part"])
    return near.withColumn("rank", F.col("_before") + F.col("_place")).where(F.col("rank") <= top).select("_row.*", "rank")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, part_of: int = PART_OF, shards: int = SHARDS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the first collocations of each language."""
    texts = _texts(docs, text_col, lang_col, shards)
    counted = cut(word_counts(texts).where((F.col("n") >= support) | F.col("word").isNull()))
    frequent_words = counted.where("word is not null")
    of_shards = counted.where("word is null")
    cells = (F.crc32("lang") - F.lit(1 << 31)).cast("int").alias("cell")  # as ``cell`` has it
    parts = of_shards.select(cells, "shard", "n").groupBy("cell", "shard").agg(F.sum("n").alias("of_shard"))
    parts = few(cut(parts.withColumn("of_all", F.sum("of_shard").over(Window.partitionBy("cell")))))
    hashes = lambda frame: frame["hash"].to_numpy().view(np.uint64)
    words = bit_table(frequent_words, _word_hashes)
    pairs = bit_table(cut(locally_frequent(local_counts(texts, (2,), words), parts, support)), hashes)
    wanted = pairs if longest < 3 else bit_table(cut(locally_frequent(local_counts(texts, tuple(range(3, longest + 1)), words, pairs), parts, support)), hashes)
    phrases = phrase_counts(texts, words, pairs, wanted, longest).where(F.col("a") >= support)
    frequent = cut(phrases.unionByName(frequent_words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("a"))))
    totals = few(of_shards.groupBy("lang").agg(F.sum("n").alias("n")))
    kept = scored(frequent, totals).join(contained(frequent, part_of), ["lang", "phrase"], "left_anti")
    ranked = first_of_each(kept.drop("words"), "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_query(documents: DataFrame) -> DataFrame:
    return collocations(documents)
