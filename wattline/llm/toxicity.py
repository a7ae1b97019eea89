"""Toxicity by nearest labelled examples.

A bounded sample of the labelled rows that are not held out is learned from. A
term is a word, or the first four to eight letters of one where these speak for
a toxic text (endings vary). A term's weight is its IDF over all documents times
its relevance, learned from the whole sample: nearly 1 for terms that toxic rows
hold much more often, ``FLOOR`` for any other word; so every word counts and what
toxic texts have in common counts most. The index holds ``INDEX_ROWS`` of the
sample, toxic and clean ones, as TF-IDF vectors of length one, in posting lists
that are cut into blocks, each with its largest weight. A text's nearest examples
by cosine are exact: the blocks with the highest sums of block maxima are read
first, then only the parts of posting lists that lie in blocks whose sum reaches
the k-th best cosine so far. The votes of the nearest, weighted by cosine, are
turned into a share by how often such votes were right on the sample, each row
without itself. Scoring is a map over all documents; the index is bounded by
``INDEX_ROWS`` and ``FIT_ENTRIES``.

Edge cases: a null, empty or unknown text has no terms and gets the share of
toxic rows among examples without terms; labels that are null or of no document
are not used; of several labels for one id the largest holds, of several texts
the one with the smallest hash; a null id is not held out; without labels of both
kinds every score is 0; equal cosines go to the example that comes first; further
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import by_batch, cut

#: Labelled rows that are learned from, those of them that are the index (half of them toxic ones, if there are so
#: many), and the different words that these may have together, at most.
FIT_ROWS, INDEX_ROWS, FIT_ENTRIES = 10_000, 2048, 1 << 21
#: A term speaks for a toxic text if it is so many times as frequent there; with this chi-square it has half its relevance.
LIFT, CHI_SQUARE = 3.0, 30.0
#: The relevance of all other words, and the least that the beginning of a word must have.
FLOOR, PREFIX_FLOOR = 0.05, 0.25
#: Relevance under this counts as none.
LEAST = 0.01
PREFIXES = (4, 5, 6, 7, 8)
NEIGHBOURS, BLOCK = 15, 64
#: Blocks that are read first.
FIRST = 3
#: Votes are told apart in so many steps, between which shares are interpolated.
STEPS = 20
#: Bytes of texts that are taken apart at once.
AT_ONCE = 1 << 20
THRESHOLD = 0.3

LETTERS = re.compile(r"[^\W\d_]+")

Vector = tuple[np.ndarray, np.ndarray]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def words_of(raw: str) -> list[str]:
    return [raw] if raw.isalpha() else LETTERS.findall(raw)


def word_counts(text: str | None) -> dict[str, int]:
    counts: dict[str, int] = {}
    for raw, n in Counter((text or "").lower().split()).items():
        for w in words_of(raw):
            counts[w] = counts.get(w, 0) + n
    return counts


def prefixes(word: str) -> list[str]:
    return [word[:n] + "*" for n in PREFIXES if len(word) > n]


def relevance(sample: DataFrame) -> dict[str, float]:
    """Terms that toxic rows of ``toxic``, ``words`` hold more often, with their relevance from ``LEAST`` up to 1."""
    n_toxic, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_clean = n - n_toxic
    if not n_toxic or not n_clean:
        return {}

    def count(frame: pa.RecordBatch) -> dict[str, pa.Array]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for words, label in zip(frame["words"].to_pylist(), frame["toxic"].to_pylist(), strict=True):
            seen[label].update({t for w in words for t in (w, *prefixes(w))})
        terms = list(seen[0] | seen[1])
        return {"term": pa.array(terms, pa.string()), "a": pa.array([seen[1][t] for t in terms], pa.int64()), "b": pa.array([seen[0][t] for t in terms], pa.int64())}

    counts = by_batch(sample.select("toxic", "words"), lambda: count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = n * (a * (n_clean - b) - b * (n_toxic - a)) ** 2 / ((a + b) * (n - a - b) * float(n_toxic) * n_clean)
    speaks = counts.where((a > 2) & (a + b < n) & (a / n_toxic >= LIFT * (b + 0.5) / n_clean)).select("term", chi.alias("chi"))
    strength = F.col("chi") * F.col("chi") / (F.col("chi") * F.col("chi") + CHI_SQUARE * CHI_SQUARE)
    speaks = speaks.select("term", strength.alias("r")).where(F.col("r") >= F.when(F.col("term").endswith("*"), PREFIX_FLOOR).otherwise(LEAST))
    return {r["term"]: r["r"] for r in speaks.collect()}


class Terms:
    """From words to the numbers of their terms."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers
        self.known = pa.array(list(numbers), pa.string())
        # for each length the beginnings that are terms, and their numbers
        heads = {n: [t for t in numbers if t.endswith("*") and len(t) == n + 1] for n in PREFIXES}
        self.heads = [(n, pa.array([t[:-1] for t in ts], pa.string()), np.array([numbers[t] for t in ts] + [-1])) for n, ts in heads.items() if ts]

    def __getitem__(self, raw: str) -> list[int]:
        return [self.numbers[t] for w in words_of(raw) for t in (w, *prefixes(w)) if t in self.numbers]

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the numbers of each word's terms start, how many there are, and all of them. Most are words of letters
        between signs, which are looked up as a column."""
        plain = pc.utf8_trim(words, characters=punctuation)
        simple = pc.utf8_is_alpha(plain).to_numpy(zero_copy_only=False)
        place = lambda column, known: pc.fill_null(pc.index_in(column, known), -1).to_numpy().astype(np.int64)
        columns, size = [place(plain, self.known)], pc.utf8_length(plain).to_numpy()
        for n, heads, numbers in self.heads:
            columns.append(np.where(size > n, numbers[place(pc.utf8_slice_codeunits(plain, 0, n), heads)], -1))
        each = np.where(simple[:, None], np.stack(columns, 1), -1)
        lengths = (each >= 0).sum(1)
        starts, every = np.cumsum(lengths) - lengths, each[each >= 0]
        others = np.flatnonzero(~simple)
        found = [self[w] for w in words.take(pa.array(others)).to_pylist()]
        lengths[others] = np.fromiter(map(len, found), np.int64, len(found))
        starts[others] = len(every) + np.cumsum(lengths[others]) - lengths[others]
        return starts, lengths, np.concatenate([every, np.fromiter(chain.from_iterable(found), np.int64)])

    def counted(self, words: Iterable[tuple[str, int]]) -> Vector:
        counts: dict[int, int] = {}
        for word, n in words:
            for t in self[word]:
                counts[t] = counts.get(t, 0) + n
        return np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))

    def of(self, texts: pa.Array) -> Iterator[Vector]:
        """For each text its terms, in order, and how often each stands there. Words are told apart and lower-cased as Arrow
        columns, some megabytes at a time; what is looked up here are the different words of those."""
        part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(texts)], strict=True):
            words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.slice(lo, hi - lo), "")))
            flat = words.flatten().dictionary_encode()
            first, lengths, numbers = self._looked_up(flat.dictionary)
            at = flat.indices.to_numpy()
            texts_of = np.repeat(np.repeat(np.arange(hi - lo), np.diff(words.offsets.to_numpy())), lengths[at])
            every = numbers[_ranges(first[at], lengths[at])]
            n = max(len(self.numbers), 1)
            cells, times = np.unique(texts_of * n + every, return_counts=True)
            bounds = np.searchsorted(cells, np.arange(hi - lo + 1) * n)
            for a, b in pairwise(bounds.tolist()):
                yield cells[a:b] % n, times[a:b]


class Index:
    """Posting lists in blocks with their maxima."""

    def __init__(self, vectors: list[Vector], labels: list[int], ids: list, weights: np.ndarray):
        self.weights = weights
        unit = [self.unit(v) for v in vectors]
        # examples that share their heaviest term, or else their most widespread one, stand together: block maxima are tight then
        spread = Counter(t for terms, _ in unit for t in terms.tolist())
        def key(i: int):
            terms, w = unit[i]
            common = [(v * spread[t], t) for t, v in zip(terms.tolist(), w.tolist(), strict=True) if spread[t] > 2]
            return (labels[i], max(common, default=(0.0, -1))[1], i)
        order = sorted(range(len(unit)), key=key)
        unit = [unit[i] for i in order]
        self.labels, self.ids = np.array([labels[i] for i in order], np.float64), [ids[i] for i in order]
        self.place = {i: e for e, i in enumerate(self.ids)}
        self.n_blocks = -(-len(order) // BLOCK)
        # postings by term, then example; segments are the parts of a term's list in one block
        terms = np.concatenate([t for t, _ in unit]) if unit else np.zeros(0, np.int64)
        examples = np.repeat(np.arange(len(unit)), [len(t) for t, _ in unit])
        at = np.lexsort((examples, terms))
        self.examples, self.values = examples[at].astype(np.int64), (np.concatenate([w for _, w in unit]) if unit else np.zeros(0))[at]
        cell = terms[at] * self.n_blocks + self.examples // BLOCK
        self.seg_start = np.flatnonzero(np.diff(cell, prepend=-1))
        self.seg_length = np.diff(self.seg_start, append=len(cell))
        self.seg_block = (cell[self.seg_start] % max(self.n_blocks, 1)).astype(np.int64)
        self.seg_most = np.maximum.reduceat(self.values, self.seg_start) if len(cell) else np.zeros(0)
        of_term = cell[self.seg_start] // max(self.n_blocks, 1)
        self.term_from = np.searchsorted(of_term, np.arange(len(weights) + 1))

    def unit(self, counts: Vector) -> Vector:
        terms, times = counts
        raw = (1 + np.log(times)) * self.weights[terms]
        keep = raw > 0
        terms, raw = terms[keep], raw[keep]
        norm = math.sqrt(float(raw @ raw))
        return (terms, raw / norm) if norm else (terms[:0], raw[:0])

    def nearest(self, query: Vector, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples (fewer, if fewer share a term)."""
        terms, w = query
        first, n_segs = self.term_from[terms], self.term_from[terms + 1] - self.term_from[terms]
        segs = _ranges(first, n_segs)
        if not len(segs):
            return np.zeros(0, np.int64), np.zeros(0)
        factor, block = np.repeat(w, n_segs), self.seg_block[segs]
        bound = np.bincount(block, factor * self.seg_most[segs], self.n_blocks)
        cosines = np.zeros(self.n_blocks * BLOCK)

        def read(wanted: np.ndarray) -> float:
            """Adds what the wanted blocks hold; the k-th best cosine so far."""
            here = wanted[block]
            lengths = self.seg_length[segs[here]]
            places = _ranges(self.seg_start[segs[here]], lengths)
            cosines[:] += np.bincount(self.examples[places], np.repeat(factor[here], lengths) * self.values[places], len(cosines))
            if but >= 0:
                cosines[but] = 0
            return float(np.partition(cosines, -k)[-k]) if len(cosines) >= k else 0.0

        started = np.zeros(self.n_blocks, bool)
        started[np.argpartition(bound, -FIRST)[-FIRST:] if self.n_blocks > FIRST else slice(None)] = True
        kth = read(started)
        read(~started & (bound >= kth - 1e-12))
        found = np.flatnonzero(cosines > 0)
        if len(found) > k:
            found = found[cosines[found] >= np.partition(cosines[found], -k)[-k] - 1e-9]
        found = found[np.lexsort((found, -np.round(cosines[found], 12)))][:k]
        return found, cosines[found]

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        return float((cosines * self.labels[places]).sum() / cosines.sum()) if len(places) else 0.0


class Calibration:
    """From votes to shares of toxic rows."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, without: tuple[int, int]):
        steps = np.minimum((votes * STEPS).astype(int), STEPS - 1)
        hits, sums = np.bincount(steps, labels, STEPS), np.bincount(steps, minlength=STEPS)
        self.middle = (np.arange(STEPS) + 0.5) / STEPS
        self.share = np.maximum.accumulate((hits + self.middle) / (sums + 1))
        self.empty = (without[0] + 0.01) / (without[1] + 1)

    def of(self, vote: float) -> float:
        return float(np.interp(vote, self.middle, self.share))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """``doc_id``, ``toxic``, ``words``, ``counts`` of ``fit_rows`` labelled rows that may be learned from, those with the smallest hashes."""
    rows = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    drawn = cut(rows.orderBy(F.xxhash64(F.lit("draw"), "doc_id"), "doc_id").limit(fit_rows))
    # bounded by fit_rows: two numbers a row
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(frame: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [word_counts(t) for t in frame["text"].to_pylist()]
        lists = {"words": pa.array([list(c) for c in found], pa.list_(pa.string())), "counts": pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))}
        return {"doc_id": frame["doc_id"], "toxic": frame["toxic"]} | lists

    return cut(by_batch(texts, lambda: count, f"doc_id {kind}, toxic int, words array<string>, counts array<long>"))


def _examples(sample: DataFrame, index_rows: int, fit_entries: int) -> list:
    """Rows of the sample for the index, by hash: toxic ones up to a half, then clean ones; of each kind no more than have half
    of ``fit_entries`` words, and a longer text does not keep later ones out."""
    h = F.xxhash64(F.lit("draw"), "doc_id")
    sizes = sample.where("size(words) > 0").select("doc_id", "toxic", F.size("words").alias("n"), h.alias("h")).orderBy("h", "doc_id").toArrow().to_pylist()
    chosen: list = []
    for toxic, room in ((1, index_rows // 2), (0, None)):
        room, words = index_rows - len(chosen) if room is None else room, 0
        for r in sizes:
            # a text that finds no room is passed over, later ones still may
            if r["toxic"] == toxic and room and words + r["n"] <= fit_entries // 2:
                chosen.append(r["doc_id"])
                words += r["n"]
                room -= 1
    # bounded by index_rows
    ids = F.broadcast(sample.sparkSession.createDataFrame([(i,) for i in chosen], sample.select("doc_id").schema))
    return sample.join(ids, "doc_id", "left_semi").withColumn("h", h).orderBy("h", "doc_id").toArrow().to_pylist()


def _frequencies(docs: DataFrame, numbers: dict[str, int]) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each term."""
    known = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, sums, n = Terms(known.value), np.zeros(len(known.value) + 1, np.int64), 0
        for frame in frames:
            n += frame.num_rows
            for held, _ in terms.of(frame["text"]):
                sums[held] += 1
        sums[-1] = n
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"t": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})

    # a row for each term that the fitted rows hold, at most
    got = docs.select("text").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(numbers) + 1, np.int64)
    df[got["t"].to_numpy()] = got["n"].to_numpy()
    known.unpersist()
    return int(df[-1]), df[:-1]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, index_rows: int = INDEX_ROWS, fit_entries: int = FIT_ENTRIES) -> tuple[dict[str, int], Index, Calibration] | None:
    """Numbers of terms, index and calibration; None without labels of both kinds."""
    sample = _sample(docs, labels, fit_rows)
    if sample.select("toxic").distinct().count() < 2:
        return None
    speaks = relevance(sample)
    rows = _examples(sample, index_rows, fit_entries)
    numbers: dict[str, int] = {}
    for r in rows:
        for w in r["words"]:
            for t in (w, *(p for p in prefixes(w) if p in speaks)):
                numbers.setdefault(t, len(numbers))
    n_docs, df = _frequencies(docs, numbers)
    factor = np.array([speaks[t] if t.endswith("*") else FLOOR + (1 - FLOOR) * speaks.get(t, 0.0) for t in numbers])
    weights = (np.log((1 + n_docs) / (1 + df)) + 1) * factor
    terms = Terms(numbers)
    vectors = [terms.counted(zip(r["words"], r["counts"], strict=True)) for r in rows]
    index = Index(vectors, [r["toxic"] for r in rows], [r["doc_id"] for r in rows], weights)
    shared = docs.sparkSession.sparkContext.broadcast((numbers, index))

    def votes():
        numbers, index = shared.value
        terms = Terms(numbers)

        def do(frame: pa.RecordBatch) -> dict[str, pa.Array]:
            out = []
            for doc_id, words, n in zip(frame["doc_id"].to_pylist(), frame["words"].to_pylist(), frame["counts"].to_pylist(), strict=True):
                counts = terms.counted(zip(words, n, strict=True))
                places, cosines = index.nearest(index.unit(counts), but=index.place.get(doc_id, -1))
                out.append(index.vote(places, cosines) if len(places) else None)
            return {"toxic": frame["toxic"], "vote": pa.array(out, pa.float64())}

        return do

    # two numbers for each row of the sample
    got = by_batch(sample, votes, "toxic int, vote double").toArrow()
    shared.unpersist()
    label, vote = got["toxic"].to_numpy().astype(np.float64), got["vote"].to_numpy().astype(np.float64)
    none = np.isnan(vote)
    return numbers, index, Calibration(vote[~none], label[~none], (int(label[none].sum()), int(none.sum())))


def _rate(docs: DataFrame, labels: DataFrame, **options):
    """A function of a column of texts that gives structs of ``score`` and ``evidence`` (ids of the nearest examples), fitted
    to ``docs``. Only texts go to Python, only structs come back."""
    model, kind = fit(docs, labels, **options), docs.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ids = to_arrow_type(kind)

    @F.arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(kind))]))
    def rate(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        if model is not None:
            numbers, index, calibration = model
            terms = Terms(numbers)
        for texts in columns:
            scores, evidence = [], []
            for counts in terms.of(texts) if model is not None else ():
                places, cosines = index.nearest(index.unit(counts))
                scores.append(calibration.of(index.vote(places, cosines)) if len(places) else calibration.empty)
                evidence.append([index.ids[p] for p in places])
            scores, evidence = (scores, evidence) if model is not None else ([0.0] * len(texts), [[]] * len(texts))
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(ids))], ["score", "evidence"])

    return rate


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and ``evidence`` (ids of the examples)."""
    rate = _rate(docs.select("doc_id", "text"), labels, **options)
    rows = docs.select("doc_id", rate("text").alias("_rated")).select("doc_id", F.col("_rated.score").alias("score"), F.col("_rated.evidence").alias("evidence"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text is predicted to be toxic. Nothing is shuffled."""
    rate = _rate(docs.select("doc_id", "text"), labels, **options)
    return docs.where(rate("text")["score"] < THRESHOLD)


def op2_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).select("doc_id", "held_out", "score", "predicted", "evidence")
