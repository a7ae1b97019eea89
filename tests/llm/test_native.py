"""Mixing, line dedup, url rules and sharding."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from wattline.llm import line_dedup, mixing, queries, sharding, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, size int, shard string, quota int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", 1, "clash", 2) for i, t, s in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus():
    rows = []
    for i in range(120):
        source = None if i % 17 == 0 else f"s{i % 3 if i % 2 else 0}"
        n = 40000 if i == 7 else (i * 37) % 300
        rows.append((i, " ".join(f"w{i}_{k}" for k in range(n)) if i % 11 else (None if i % 22 else "")[:0] if i % 22 == 0 else None, source))
    return rows


def highest(weights, seats):
    """Seats by listing every quotient."""
    out = Counter()
    quotients = sorted(((-w / (2 * k - 1), key, k) for key, w in weights.items() for k in range(1, seats + 1)), key=lambda q: q)
    for _, key, _ in quotients[:seats]:
        out[key] += 1
    return out


@pytest.mark.parametrize("weights,seats", [({1: 10, 2: 7, 3: 1}, 9), ({1: 5, 2: 5, 3: 5}, 4), ({1: 100, 2: 1, 3: 1, 4: 1}, 1), ({1: 3}, 8), ({k: k for k in range(1, 12)}, 17)])
def test_sainte_lague(spark, weights, seats):
    cells = spark.createDataFrame([("g", k, float(w), seats) for k, w in weights.items()], "g string, key int, weight double, seats long")
    got = {r["key"]: r["quota"] for r in mixing.sainte_lague(cells, ["g"], "key", "weight", "seats").collect()}
    want = highest(weights, seats)
    assert got == {k: want[k] for k in weights}


def test_mixing(spark, corpus):
    rows = {r["doc_id"]: r for r in mixing.op1_query(docs(spark, corpus)).collect()}
    assert len(rows) == len(corpus)
    size = {i: len(words(t)) for i, t, _ in corpus}
    of = {i: s for i, _, s in corpus}
    total = sum(size.values())
    per_source = Counter()
    for i, s in of.items():
        per_source[s] += size[i]
    names = sorted([s for s in per_source if s is not None]) + ([None] if None in per_source else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full: set = set()
    while True:
        left = total - sum(3 * per_source[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, x in share.items() if x >= 3 * per_source[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for i, r in rows.items():
        assert r["size"] == size[i] and r["source_size"] == per_source[of[i]]
        assert 0 <= r["taken"] <= 3 * size[i]
        taken[of[i]] += r["taken"]
        assert r["target"] == pytest.approx(3 * per_source[of[i]] if of[i] in full else share[of[i]])
    for s in names:
        target = 3 * per_source[s] if s in full else share[s]
        assert abs(taken[s] - target) <= 64 + 0.01 * target


def test_mixing_again_and_texts(spark, corpus):
    frame = docs(spark, corpus)
    first = sorted((r["doc_id"], r["taken"]) for r in mixing.op1_query(frame).collect())
    assert first == sorted((r["doc_id"], r["taken"]) for r in mixing.op1_query(frame.repartition(7)).collect())
    mixed = mixing.mix_texts(frame)
    assert mixed.columns == frame.columns
    got = Counter()
    texts = {i: t for i, t, _ in corpus}
    for r in mixed.collect():
        own = words(r["text"])
        got[r["doc_id"]] += len(own)
        assert r["quota"] == 2 and r["n_chars"] == len(r["text"])
        assert set(own) <= set(words(texts[r["doc_id"]]))
    assert {i: n for i, n in first if n} == dict(got)


def test_mixing_empty_and_repeated(spark):
    assert mixing.op1_query(docs(spark, [])).count() == 0
    got = mixing.op1_query(docs(spark, [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, " \t ", None)])).collect()
    assert sorted(r["taken"] for r in got) == [0, 0, 2, 2]


def test_mixing_small_source_in_a_large_corpus(spark):
    """Every source's words come within a block of its target, a tiny source's too, whatever the shards and bounds."""
    rows = [(i, "w " * 1000, "a") for i in range(400)] + [(1000 + i, "v " * 5, "b") for i in range(60)] + [(2000 + i, "u " * (1 + i % 40), "c") for i in range(900)] + [(3000 + i, "t " * 700, None) for i in range(90)]
    for options, block in (({}, 64), ({"shard_words": 512, "block_words": 16}, 16), ({"shard_words": 64, "block_words": 7, "max_repeat": 2}, 7)):
        got = mixing.decide(docs(spark, rows), **options).collect()
        assert len(got) == len(rows)
        taken, target, repeat = Counter(), {}, options.get("max_repeat", 3)
        for r in got:
            mine = r["passes"] * r["_size"] + sum(p["hi"] - p["lo"] for p in r["pieces"])
            assert 0 <= mine <= repeat * r["_size"]
            taken[r["source"]] += mine
            target[r["source"]] = r["target"]
        assert {s: abs(taken[s] - target[s]) <= block for s in target} == dict.fromkeys(target, True), (options, taken, target)


def dedup(rows):
    """Brute force over plain rows."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 2 and i != min(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark):
    shared = "This line is everywhere"
    rows = [(i, f"{shared}\nonly {i} has this line\nshort\n  THIS line is everywhere \r\nÉcole des mines {i % 3}", "s") for i in range(1, 60)]
    rows += [(0, None, "s"), (99, "", None), (100, shared, "s"), (100, shared, "s"), (101, "\n\n", "s"), (102, ("x" * 50 + "\n") * 3000 + shared, "s"), (103, "x" * 50, "s"), (None, shared, "s"), (104, "école des mines 1\nÉCOLE des mines 1", "s")]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.op3_query(docs(spark, rows)).collect()), key=str)
    assert got == dedup(rows)
    assert line_dedup.op3_query(docs(spark, [])).count() == 0
    kept = line_dedup.drop_repeated_lines(docs(spark, rows))
    assert kept.columns == [*docs(spark, []).columns, "n_lines", "n_dropped"] and kept.count() == len(rows)


def test_line_dedup_threshold(spark):
    rows = [(i, "a line of three documents\na line of two documents" if i < 2 else "a line of three documents", "s") for i in range(3)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_repeated_lines(docs(spark, rows), min_docs=3).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def judged(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, action = max(fits, default=(0, None, "allow"))
    return host, path, rule, action


URLS = [
    "http://a.example.com/en/7", "http://example.com/en/70?x=1", "https://EXAMPLE.com/en/8#f", "http://com/en/", "http://xcom/en/", "http://b.net/de/1", "http://x.example.net/de/8",
    "http://example.net/de/80", "ftp://o.org/es/", "http://org", "http://org/es", "no url", None, "", "://", "http://", "http://.com/en/1", "http://a..com/en/1", "http://com./en/1",
    "http://é.example.com/en/7é", "http://example.com/en/\U0010ffff", "http://a.b.c.d.e.f.g.example.com/en/7/" + "x" * 5000, "http://example.com:80/en/7", "a://b://c.com/en/1",
]


@pytest.mark.parametrize("rules", [url_rules.RULES, [], [("block", "com", ""), ("allow", "example.com", "/"), ("block", "a.example.com", "/en"), ("allow", "a.example.com", "/en/7"), ("block", "com", "/e"), ("block", "net", "/de/"), ("allow", "net", "/de/")]])
def test_url_rules(spark, rules):
    urls = URLS * 3
    pages = spark.createDataFrame([(i, u, "<p>", "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, rule string")
    frame = spark.createDataFrame(rules, "action string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, frame).collect()}
    seen = {}
    for a, h, p in rules:
        seen[h, p] = min(a, seen.get((h, p), a))
    want = {i: judged(u, [(a, h, p) for (h, p), a in seen.items()]) for i, u in enumerate(urls)}
    assert got == want


def test_url_rules_of_the_contract(spark, tmp_path):
    """Each rule's word, spelled out here and not taken from the code."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/70": ("example.com/en/7", "allow"), "http://a.example.com/en/8": ("com/en/", "block"),
        "http://net/de/": ("net/de/", "allow"), "http://b.net/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://example.net/de/80": ("example.net/de/8", "block"), "http://x.example.net/de/8": ("example.net/de/8", "block"), "http://o.org/es/": ("org/es/", "block"),
        "http://b.net/en/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op7_url_rules(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


def test_url_rules_long_hosts_and_deep_rules(spark):
    """A host of thousands of labels, and rules nested forty deep in a path."""
    rules = [("block" if k % 2 else "allow", "example.com", "/" + "d/" * k) for k in range(40)]
    urls = ["http://" + "a." * 5000 + "example.com/d/d/d/x", "http://example.com/" + "d/" * 60, "http://" + "a." * 5000 + "org/d/", "http://example.com/d/e"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, spark.createDataFrame(rules, "action string, host string, path string")).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_url_rules_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(pages, url_rules.rules_frame(spark)).count() == 0


def test_sharding(spark):
    rows = [(i, "x" * ((i * 31) % 200), "s") for i in range(500)] + [(3, "é" * 5000, "s"), (None, None, "s"), (None, "", None), (7, "same", "s"), (7, "same", "s")]
    got = sharding.op9_query(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    total = sum(r["size"] for r in got)
    assert set(per) <= set(range(8))
    last = None
    for s in sorted(per):
        assert sorted(r["slot"] for r in per[s]) == list(range(len(per[s])))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in per[s]]
        assert last is None or min(ids) >= last
        last = max(ids)
    sizes = [sum(r["size"] for r in per[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in got) and sum(sizes) == total


def test_sharding_equal_rows(spark):
    """Rows that are all equal are dealt to several ranges and to all shards."""
    frame = docs(spark, [(7, "same text", "s")] * 4000).repartition(8)
    got = sharding.op9_query(frame).groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert sorted((r["shard"], r["max(slot)"], r["count(1)"]) for r in got) == [(s, 499, 500) for s in range(8)]
    key = [*sharding._key("doc_id", "text"), sharding.F.monotonically_increasing_id().alias("_tie")]
    assert sharding.ordered(frame.select(*key), *sharding.KEY, "_tie").select("_pid").distinct().count() > 1


def test_shard_documents(spark, tmp_path):
    rows = [(i, "x" * ((i * 31) % 200), "s") for i in range(200)]
    frame = docs(spark, rows)
    sharded = sharding.shard_documents(frame)
    assert sorted(sharded.columns) == sorted(frame.columns)
    want = {r["doc_id"]: r["shard"] for r in sharding.op9_query(frame).collect()}
    assert {r["doc_id"]: r["shard"] for r in sharded.collect()} == want
    sharding.write_shards(frame, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    assert sharding.op9_query(docs(spark, [])).count() == 0
    assert sharding.shard_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_shard_documents_spreads_equal_rows(spark, parts):
    """Equal rows are dealt to all shards that they fill, rows that differ go where ``place`` puts them."""
    same = docs(spark, [(1, "the same", "s")] * 1000).repartition(parts)
    counts = Counter(r["shard"] for r in sharding.shard_documents(same, 8).collect())
    assert sorted(counts) == list(range(8)) and all(abs(n - 125) <= 8 for n in counts.values())
    rows = [(i, f"text {i} " * (i % 7), "s") for i in range(300)] + [(150, "x" * 40, "s")] * 300 + [(None, None, "s")] * 40
    df = docs(spark, rows).repartition(parts)
    got = sharding.shard_documents(df.withColumn("shard", df["size"]), 8)
    assert got.columns == df.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert kept == Counter((i, t) for i, t, _ in rows)
    where = {r["_id"]: r["shard"] for r in sharding.place(df, 8).collect() if r["_id"] not in (150, None)}
    mine = [(r["doc_id"], r["shard"], len(r["text"] or "") + 1) for r in got.collect()]
    assert all(where[i] == s for i, s, _ in mine if i in where)
    size = Counter()
    for _, s, n in mine:
        size[s] += n
    assert max(size.values()) - min(size.values()) <= 0.05 * sum(size.values())
    assert sharding.shard_documents(docs(spark, []), 8).count() == 0
