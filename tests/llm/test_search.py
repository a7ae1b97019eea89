"""Approximate neighbours, collocations and centroid clusters."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from wattline.llm import clustering, collocations, neighbours

EMBEDDINGS = "vec_id long, embedding array<float>, label int, score string, cluster string, _row int, _v int"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", 1, 2) for i, v in rows], EMBEDDINGS)


def unit(rng, n, width=64):
    x = rng.normal(size=(n, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


# ------------------------------------------------------------------ neighbours


def exact(rows, queries, k):
    """Brute force; rows: (vec_id, vector), their place is their identity."""
    fine = [(p, i, [float(np.float32(x)) for x in v]) for p, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, _, v in fine), default=0)
    fine = [(p, i, v + [0.0] * (width - len(v))) for p, i, v in fine]
    out = []
    for p, i, q in fine:
        if i is not None and queries(i):
            found = []
            for r, j, v in fine:
                if r != p:
                    total = 0.0
                    for a, b in zip(v, q, strict=True):
                        total += (a - b) * (a - b)
                    found.append((float(np.sqrt(total)), j is None, -1 if j is None else j, r))
            out += [(i, n + 1, None if null else j, s) for n, (s, null, j, _) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def neighbour_rows(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("n,width", [(0, 4), (3, 4), (300, 16), (300, 1)])
def test_neighbours(spark, n, width):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=width) * (0.1 if i % 3 else 2)]) for i in range(n)]
    if n:
        rows += [(900, rows[1][1]), (901, rows[1][1]), (400, None), (500, []), (600, [None] * width), (700, [float("nan")] * width), (800, [float("-inf")] * width), (None, rows[1][1]), (0, rows[2][1]), (950, [0.0] * width), (350, [1.0]), (960, [-0.0, 1.0][-width:])]
    assert neighbour_rows(neighbours.op11_query(embeddings(spark, rows))) == exact(rows, lambda i: i % 100 == 0, 10)


def test_neighbours_recall(spark):
    """Unit vectors at random, a third of all rows equal, many alike: what is found is exact, nine of ten and more are."""
    rng = np.random.default_rng(5)
    x = unit(rng, 9000)
    x[3000:6000] = x[7]
    x[6000:6500] = x[8] + rng.normal(size=(500, 64)).astype(np.float32) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbour_rows(neighbours.op11_query(embeddings(spark, rows)))
    wide = x.astype(float)
    hits = 0
    for q in range(0, 9000, 100):
        d = wide - wide[q]
        far = np.sqrt(np.cumsum(d * d, axis=1)[:, -1])
        far[q] = np.inf
        want = np.lexsort((np.arange(9000), far))[:10]
        mine = sorted(r[1:] for r in got if r[0] == q)
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(far[j] == s for _, j, s in mine) and [(s, j) for _, j, s in mine] == sorted((s, j) for _, j, s in mine)
        hits += len({j for _, j, _ in mine} & set(want.tolist()))
    assert hits >= 0.95 * 900


def test_neighbours_tables_prune():
    """At random, a query meets about a fifth of the vectors; those of its own direction always."""
    x = unit(np.random.default_rng(6), 4000).astype(float)
    tables = neighbours.Tables(64)
    shard = neighbours.Shard(x, np.arange(4000), 10, tables)
    met = [len(shard.candidates(k, 0)) for k in tables.near_keys(neighbours.units(x[:50], 64))]
    assert 0.05 * 4000 < np.mean(met) < 0.3 * 4000
    scaled = tables.near_keys(neighbours.units(x[:50] * 7e200, 64))
    for i, keys in enumerate(scaled):
        assert (shard.x[shard.candidates(keys, 0)] == x[i]).all(1).any()


# ------------------------------------------------------------------ collocations


def mined(rows, support=30, longest=4, top=2000, part_of=80):
    """Brute force; rows: (text, lang)."""
    counts: dict = {}
    for text, lang in rows:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            c = counts.setdefault(lang or "und" if lang is None else lang, Counter())
            for k in range(1, longest + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        wanted = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in wanted.items():
            inside = any(len(q) > len(p) and 100 * b >= part_of * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in wanted.items())
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, phrase string, word int, hash string, n string, score int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "clash", 1, "clash", "clash", 2) for i, (t, lang) in enumerate(rows)], DOCS)


def collocation_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "is", "a", "the", "of", "straße", "Éa", " ", "don't", "x" * 50, "naïve"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ? "]) for _ in range(rng.randrange(60)))
        if i % 3 == 0:
            text += "new york city hall New  York city hall" + rng.choice(["", ".", "\r\n"])
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", "de"), (" \t\n", None), ("...", "fr"), ("once", "fr"), ("big " * 400, "big")]


def test_collocations(spark):
    rows = corpus()
    df = documents(spark, rows)
    assert collocation_rows(collocations.op12_query(df.repartition(7))) == mined(rows)
    assert collocation_rows(collocations.op12_query(df.coalesce(1))) == mined(rows)


@pytest.mark.parametrize("support,longest,top,part_of", [(3, 4, 25, 80), (1, 3, 40, 50), (8, 2, 5, 80)])
def test_collocations_of_other_sizes(spark, support, longest, top, part_of):
    rows = corpus(2, 60)
    got = collocations.collocations(documents(spark, rows).repartition(5), support=support, longest=longest, top=top, part_of=part_of)
    assert collocation_rows(got) == mined(rows, support, longest, top, part_of)


def test_collocations_of_nothing(spark):
    assert collocations.op12_query(documents(spark, [])).count() == 0
    assert collocations.op12_query(documents(spark, [(None, None), ("a b", "en")])).count() == 0


def test_collocations_frequent_in_few_shards(spark):
    """All of a phrase's occurrences in one shard, or spread over all with less than the support in each."""
    rows = [("one place only", "en")] * 30 + [(f"filler {i} words spread evenly", "en") for i in range(32)]
    df = documents(spark, rows)
    for parts in (df.coalesce(1), df.repartition(8), df.repartitionByRange(8, "text")):
        assert collocation_rows(collocations.op12_query(parts)) == mined(rows)


def test_chunks_part_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 40)
    texts = [b"a b c. d e f, " * 20, b"", b"word " * 60, b"end. of it"]
    pieces = lambda data: [w for w in (re.findall(rb"[^\x20\x09]+", p) for p in re.split(rb"[.,;:!?\x0a-\x0d]", data)) if w]
    assert [p for c in collocations.chunks(texts) for p in pieces(c)] == [p for t in texts for p in pieces(t)]


# ------------------------------------------------------------------ clusters


def clustered(rows, k=40, rounds=5):
    def whole(x):
        return max(-(2**63), min(2**63 - 1, int(np.floor(256 * np.float64(x)))))

    fine = [(i, [whole(np.float32(x)) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in fine if i is not None)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        found = [near(v)[1] for _, v in fine]
        for j in range(len(centroids)):
            mine = [v for (_, v), f in zip(fine, found, strict=True) if f == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    most = 2**63 - 1
    placed = [(i, *near(v)) for i, v in fine]
    sums = Counter()
    for _, d, j in placed:
        sums[j] += min(d, most)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, min(d, most), min(sums[j], most), min(sum(sums.values()), most), names[j]) for i, d, j in placed), key=str)


def cluster_rows(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [0, 5, 150])
def test_clusters(spark, n):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(unit(rng, n))]
    if n:
        rows += [(900, rows[1][1]), (1, rows[2][1]), (None, rows[1][1]), (901, None), (902, []), (903, rows[0][1][:63]), (904, [None] * 64), (905, [float("nan"), *rows[0][1][1:]]), (906, [float("inf"), *rows[0][1][1:]]), (907, [0.0] * 64), (908, [*rows[0][1], 0.5])]
    assert cluster_rows(clustering.op13_query(embeddings(spark, rows))) == clustered(rows)


def test_clusters_of_huge_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (v * (10.0 ** (i % 13 * 3))).astype(np.float32).tolist()) for i, v in enumerate(unit(rng, 60))]
    assert cluster_rows(clustering.op13_query(embeddings(spark, rows))) == clustered(rows)


def test_clusters_without_ids(spark):
    assert [r[:2] for r in cluster_rows(clustering.op13_query(embeddings(spark, [(None, [0.5] * 64)])))] == [(None, 0)]


@pytest.mark.parametrize("spread", [0.01, 0.3, 1.0])
def test_progressive_search(spread):
    """Exact for all, ties included, and with fewer differences than all where centroids lie apart."""
    rng = np.random.default_rng(9)
    c = rng.integers(-200, 200, (40, 64))
    c[5] = c[17]
    x = c[rng.integers(0, 40, 700)] + np.rint(rng.normal(size=(700, 64)) * 200 * spread).astype(np.int64)
    order = clustering.walsh_order(64)
    near, far, done = clustering.progressive(clustering.transform(x)[:, order], clustering.transform(c)[:, order])
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (near == every.argmin(1)).all() and (far == every.min(1)).all()
    if spread < 0.1:
        assert done < 0.5 * 700 * 40 * 64


def test_walsh_order():
    rows = clustering.transform(np.eye(64, dtype=np.int64))[:, clustering.walsh_order(64)].T
    assert ((rows[:, 1:] != rows[:, :-1]).sum(1) == np.arange(64)).all() and (rows @ rows.T == 64 * np.eye(64)).all()
