"""Personal data in texts: fixed forms, and a character-level BiLSTM-CRF for what they miss.

The four forms (e-mail, ip, card, phone) are found in every whole text. Their
spans, in windows drawn from all documents, label the training windows of the
tagger; varied forms of the same values (other separators, missing signs) are
put into further windows, so that the tagger learns to find what the forms do
not, and so are numbers that are no personal data (dates, times, prices,
versions, counts, ranges of years, book and article numbers, coordinates);
windows that may hold such a varied form unlabelled are left
out. Every text is then cut into overlapping windows; each is
decoded, and every character takes its label from the window in whose middle it
stands most. A tagged span must hold a digit, an @ or a bracketed "at", and each
of its characters must be within ``REACH`` of one; so only the windows that hold
one and their neighbours are decoded, and that the others change nothing is tested.

Edge cases: a null text is empty; base spans always stay, and a tagged span that
touches one is dropped; of equal starts the kinds keep their order; a tagged span
that cuts a word or number is dropped; its kind is the tagged one if the value
can be of that kind once its separators are undone (an address; four numbers of
255 at most; 14 to 19 digits with a right check digit; 10 to 15 digits), else the
one other kind that it can be of, else it is dropped; without any labelled window
nothing is added; other columns are not read.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from itertools import cycle, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import by_batch, cut
from .tagger import Tagger

#: Fixed values of the contract: the kinds in their order, and their forms.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: What stands for an @ or a dot in an address.
AT = re.compile(r"\s*+(?:@|[(\[{<]\s?(?:at|@)\s?[)\]}>])\s*+", re.I)
DOT = re.compile(r"\s++\.\s++|\s*+[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s*+", re.I)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: What a tagged part of a value is widened to, where it is no value itself.
ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]++(?:{AT.pattern})[A-Za-z0-9-]++(?:(?:\.|{DOT.pattern})[A-Za-z0-9-]++)++", re.I)
NUMBERS = re.compile(r"[(\[]?[0-9]++(?:[^0-9A-Za-z,;\n]{1,4}[0-9]++)*+")
TRIGGER = re.compile(r"[0-9@]|[(\[{<]\s?at\s?[)\]}>]", re.I)
#: What may be a value in another form: an @, or three numbers with signs between.
UNSURE = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]|[0-9]++(?:[^0-9A-Za-z]{1,4}[0-9]++){2}", re.I)

#: Characters in a window, and from one window to the next.
WINDOW, STEP = 64, 32
#: A tagged span's characters are nearer than this to a digit or an @ in it.
REACH = WINDOW - STEP // 2
#: Labelled windows that the tagger is fitted on: a sixth for each kind, a third without a span.
FIT_WINDOWS = 768
#: Further windows: with varied forms of a span's value, for each kind, and with numbers of other sorts; about so many however
#: few windows there are.
VARIED, OTHER = 512, 768
#: No span counts as less likely by this (a logarithm) than it was trained: what is no value is dropped afterwards.
LEAN = 0.75
#: State of each direction of the tagger.
HIDDEN = 32

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is visited once; its local part is walked back to the last match at most."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed forms."""
    found: list[Span] = [(a, 0, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found)


def labels(length: int, spans: list[Span]) -> np.ndarray:
    """0 outside, 1 + 2k at the start of a span of kind k, 2 + 2k inside."""
    out = np.zeros(length, np.int64)
    for a, k, b in spans:
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def _fit_windows(texts: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Windows around the spans of a text and around other digits, with their labels as digits. A window in which something
    outside the spans may be a value in another form is not offered: that it is none, the forms do not tell."""
    for text in texts:
        if not text or not TRIGGER.search(text):
            continue
        spans = base_spans(text)
        centres = [a for a, _, _ in spans] or [m.start() for m in TRIGGER.finditer(text)][:1]
        for c in centres:
            lo = max(0, c - WINDOW // 3)
            hi = min(len(text), lo + WINDOW)
            inside = [(max(a, lo) - lo, k, min(b, hi) - lo) for a, k, b in spans if a < hi and b > lo]
            if any(all(m.start() >= b or m.end() <= a for a, _, b in inside) for m in UNSURE.finditer(text[lo:hi])):
                continue
            yield text[lo:hi], "".join(map(str, labels(hi - lo, inside)))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _varied(value: str, kind: int, rng: random.Random, words: list[str]) -> str:
    """Another way to write a value of a kind; names are made of the texts' own words, so that these do not give them away."""
    if kind == 0:
        if rng.random() < 0.6:
            w, n = lambda: rng.choice(words), lambda: str(rng.randrange(100)) if rng.random() < 0.5 else ""
            name = rng.choice([value.split("@")[0], f"{w()}{n()}", f"{w()}.{w()}{n()}", f"{w()}_{w()}", f"{w()[:1]}.{w()}{n()}"])
            value = f"{name}@{w()}{rng.choice(['', n(), '-' + w(), '.' + w()])}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"
        name, host = value.split("@", 1)
        inner, outer = rng.choice(["", "", " "]), rng.choice(["", " "])
        put = lambda sign: outer + rng.choice(["(%s)", "[%s]", "{%s}", "<%s>"]) % f"{inner}{sign}{inner}" + outer
        if rng.random() < 0.3:
            host = host.replace(".", rng.choice([" . ", put("."), put("dot")]))
        return name + rng.choice([" @ ", "@ ", " @", put("at"), put("at"), put("AT"), put("@")]) + host
    pad = rng.choice(["", "", " "])
    if kind == 1:
        if rng.random() < 0.5:
            low, high = rng.choice([(0, 10), (0, 100), (0, 256), (100, 256)])
            value = ".".join(str(rng.randrange(low, high)) for _ in range(4))
        sign = rng.choice(["-", "-", ":", "_", "/", "|", "\u2013", "[.]", "(.)", "{.}", "[dot]"])
        return value.replace(".", rng.choice([" . ", ". ", " .", pad + sign + pad, pad + sign + pad]))
    digits = re.sub(r"\D", "", value)
    if kind == 2:
        if rng.random() < 0.5:
            digits = (rng.choice("3456") + "".join(rng.choice("0123456789") * rng.choice([1, 1, 2, 4]) for _ in range(16)))[:16]
        cuts = [0, 4, 10, 15] if rng.random() < 0.15 else [*range(0, len(digits), 4), len(digits)]
        sign = rng.choice(["  ", "--"]) if rng.random() < 0.2 else pad + rng.choice(["-", ".", "|", "\u2013"] if pad else [".", "/", "_", ":", "|", "\u2013"]) + pad
        return sign.join(digits[x:y] for x, y in pairwise(sorted({*cuts})))
    if rng.random() < 0.4:
        digits = rng.choice(["1", "33", "44", "49"]) + rng.choice("23456789") + _digits(rng, 9)
    a, b, c = digits[:-7][-3:], digits[-7:-4], digits[-4:]
    x, y = (pad + rng.choice("--../ _\u2013") + pad if rng.random() < 0.8 else " " for _ in range(2))
    y = rng.choice([x, x, y])
    area = rng.choice(["{a}{x}", "{a}{x}", "({a}) ", "({a})", "({a}){x}", "[{a}] ", "({a})-"])
    front = rng.choice(["", "", "{n}{x}", "{n} ", "00{n} ", "00{n}{x}", "0"])
    rest = rng.choice(["{b}{y}{c}", "{b}{y}{c}", "{b}{c}", "{p}{y}{q}{y}{r}"]) if front[:1] in ("0", "{") else "{b}{y}{c}"
    return (front + area + rest).format(a=a, b=b, c=c, n=digits[:-10] or "1", x=x, y=y, p=b[:2], q=b[2:] + c[:1], r=c[1:])


def _other(rng: random.Random) -> str:
    """A number, or a name with an @, that is no personal data."""
    n = lambda k: _digits(rng, k)
    day = f"20{n(2)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
    clock = f"{rng.randrange(24):02d}:{rng.randrange(60):02d}"
    year = rng.randrange(1900, 2030)
    if rng.random() < 0.5:
        book = rng.choice(["978", "979"])
        return rng.choice(
            [
                f"{book}-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{book}-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{book} {n(1)} {n(3)} {n(5)} {n(1)}", f"{book}{n(10)}", f"{n(1)}-{n(3)}-{n(5)}-{n(1)}", f"{n(1)} {n(5)} {n(5)} {n(1)}",
                f"{year}-{year + 1}-{year + 2}", f"{year}, {year + 2}, {year + 3}", f"{year}-{year + rng.randrange(1, 30)}", f"{year}/{year + 1}", f"{year} {year + 1} {year + 2}", f"{day} {clock}:{n(2)}", f"{day}T{clock}", f"{day} - 20{n(2)}-{n(2)}-{n(2)}", n(rng.randrange(13, 18)),
                f"{n(4)} {n(4)} {n(4)}", f"{n(4)}-{n(4)}-{n(4)}", f"{rng.randrange(90)}.{n(4)}, -{rng.randrange(180)}.{n(4)}", f"{rng.randrange(90)}.{n(5)}, {rng.randrange(180)}.{n(5)}", f"{rng.randrange(1, 9)},{n(3)},{n(3)},{n(3)}", f"{rng.randrange(1, 9)} {n(3)} {n(3)} {n(3)}",
                f"{rng.randrange(100, 400)}-{rng.randrange(400, 999)}, {n(4)}", f"{n(4)}-{n(4)}, {n(4)}", f"{n(3)}, {n(3)}, {n(3)}, {n(4)}", f"10.{n(4)}/{n(3)}.{n(4)}", f"{n(2)}-{n(2)}, {n(2)}-{n(2)}, {n(2)}-{n(2)}", f"{n(2)} {n(2)} {n(2)} {n(2)}",
                f"20{n(2)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d} {n(6)}", f"{n(2)}.{n(5)} {rng.choice('/|-')} {n(2)}.{n(5)}", f"{n(1)} {n(4)} {n(4)} {n(4)}", f"{n(5)} {n(5)} {n(5)}",
            ]
        )
    return rng.choice(
        [
            day, f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.20{n(2)}", f"{rng.randrange(1, 29)}/{rng.randrange(1, 13)}/20{n(2)}",
            f"{rng.randrange(24)}:{n(2)}", f"{rng.randrange(24)}:{n(2)}:{n(2)}", f"{rng.randrange(1, 10)}.{rng.randrange(30)}.{rng.randrange(30)}", f"v{rng.randrange(1, 10)}.{rng.randrange(30)}",
            f"{rng.randrange(1, 999)},{n(3)}.{n(2)}", f"${rng.randrange(1, 999)}.{n(2)}", f"{rng.randrange(100)}.{n(rng.randrange(1, 4))}%", n(rng.randrange(1, 13)), f"{n(2)}-{n(3)}", f"#{n(5)}",
            f"{n(3)} {n(3)}", f"{rng.randrange(1, 99)} - {rng.randrange(1, 99)}", f"@{rng.choice(['home', 'team', 'all', 'user'])}{n(rng.randrange(3))}", f"3 @ {rng.randrange(1, 99)}", f"{rng.choice('ABCDEF')}{n(4)}-{n(2)}", "(at) the", "[at] a",
        ]
    )


def draw(windows: DataFrame, number: int) -> list[Row]:
    """``number`` rows (or all) of distinct ``window``, ``tags``: of each kind of the first span a sixth, the other third
    without a span, in each the smallest hashes; where there are too few, the smallest hashes of the rest fill up.
    At most ``number`` rows of each come to the driver."""
    group = F.expr(f"cast(coalesce((try_cast(regexp_extract(tags, '[1-9]', 0) as int) - 1) div 2, {len(KINDS)}) as int)")
    order = ["hash", "window", "tags"]
    marked = windows.select("window", "tags", F.xxhash64("window", "tags").alias("hash"), group.alias("group"))
    best = marked.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(*order))).where(F.col("place") <= number)
    rows = sorted(best.collect(), key=lambda r: (r["group"], r["place"]))
    ranked = [[r for r in rows if r["group"] == k] for k in range(len(KINDS) + 1)]
    share = number // (len(KINDS) + 2)
    quotas = [share] * len(KINDS) + [number - share * len(KINDS)]
    drawn = [r for rows, n in zip(ranked, quotas, strict=True) for r in rows[:n]]
    rest = sorted((r for rows, n in zip(ranked, quotas, strict=True) for r in rows[n:]), key=lambda r: (r["hash"], r["window"], r["tags"]))
    return drawn + rest[: number - len(drawn)]


def fit(docs: DataFrame, text_col: str = "text", fit_windows: int = FIT_WINDOWS, seed: int = 7) -> Tagger | None:
    """A tagger fitted on ``fit_windows`` different windows; every document offers its own, and a hash picks."""

    def offer(frame: pa.RecordBatch) -> dict[str, pa.Array]:
        found = list(_fit_windows(frame["_text"].to_pylist()))
        return {"window": pa.array([w for w, _ in found], pa.string()), "tags": pa.array([t for _, t in found], pa.string())}

    windows = by_batch(docs.select(F.col(text_col).alias("_text")), lambda: offer, "window string, tags string")
    windows = cut(windows.distinct())
    drawn = draw(windows, fit_windows)
    if not any(set(r["tags"]) - {"0"} for r in drawn):
        return None
    return trained([(r["window"], r["tags"]) for r in drawn], seed)


def trained(drawn: list[tuple[str, str]], seed: int = 7) -> Tagger:
    tagger = Tagger(1 + 2 * len(KINDS), hidden=HIDDEN, seed=seed).fit(*_training(drawn, random.Random(seed)), epochs=8, batch=128, rate=0.03)
    tagger.p["out_b"][0] -= LEAN
    return tagger


def _training(drawn: list[tuple[str, str]], rng: random.Random) -> tuple[list[str], list[np.ndarray]]:
    """The drawn windows; for those that have one whole span further ones with a varied value in its place; and for all, in turn,
    ones with a number of another sort."""
    texts, tags = [], []
    words = sorted({w.lower() for window, _ in drawn for w in re.findall("[A-Za-z]{2,}", window)}) or ["a"]
    whole: dict[int, list[tuple[str, int, int]]] = {k: [] for k in range(len(KINDS))}
    places: list[tuple[str, int, int]] = []
    for window, marks in drawn:
        texts.append(window)
        tags.append(np.array(list(map(int, marks))))
        starts = [i for i, t in enumerate(marks) if t in "1357"]
        if not starts:
            # one number more, at the start of a word
            places += [(window, m.start(), m.start()) for m in re.finditer(r"(?<!\S)\S", window)][:: WINDOW // 8]
        elif len(starts) == 1:
            a, kind = starts[0], int(marks[starts[0]]) // 2
            b = a + 1
            while b < len(marks) and marks[b] == str(2 + 2 * kind):
                b += 1
            if b < len(marks):
                whole[kind].append((window, a, b))
                places.append((window, a, b))

    def add(window: str, a: int, b: int, new: str, kind: int | None) -> None:
        # windows begin at other places of the text too
        skip = rng.randrange(a + 1)
        text = (window[skip:a] + new + window[b:])[:WINDOW]
        texts.append(text)
        tags.append(labels(len(text), [] if kind is None else [(a - skip, kind, min(len(text), a - skip + len(new)))]))

    for kind, found in whole.items():
        for window, a, b in islice(cycle(found), VARIED if found else 0):
            add(window, a, b, _varied(window[a:b], kind, rng, words), kind)
    rng.shuffle(places)
    for window, a, b in islice(cycle(places), OTHER if places else 0):
        add(window, a, b, _other(rng) + " " * (a == b), None)
    return texts, tags


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @, and of their neighbours."""
    starts: set[int] = set()
    last = max(0, -(-(len(text) - WINDOW) // STEP))
    for m in TRIGGER.finditer(text):
        first = max(0, -(-(m.start() - WINDOW + 1) // STEP) - 1)
        starts.update(range(first, min(last, m.start() // STEP + 1) + 1))
    return sorted(s * STEP for s in starts)


def _near_triggers(text: str, a: int, b: int) -> bool:
    """Whether every character from a to b is nearer than REACH to a digit or an @ there."""
    at = [m.start() for m in TRIGGER.finditer(text, a, b)]
    return bool(at) and at[0] - a < REACH and b - 1 - at[-1] < REACH and all(y - x < 2 * REACH for x, y in pairwise(at))


def reconcile(text: str, starts: list[int], tags: list[np.ndarray]) -> list[Span]:
    """Spans of a text from its windows' labels: each character's comes from the window in which it is farthest from an edge."""
    if not any(t.any() for t in tags):
        return []
    depth, best = np.full(len(text), -1, np.int32), np.zeros(len(text), np.int8)
    for s, t in zip(starts, tags, strict=True):
        n = len(t)
        left = np.full(n, WINDOW) if s == 0 else np.arange(n)
        right = np.full(n, WINDOW) if s + n >= len(text) else np.arange(n)[::-1]
        here = np.minimum(left, right)
        deeper = here > depth[s : s + n]
        depth[s : s + n][deeper] = here[deeper]
        best[s : s + n][deeper] = t[deeper]
    found, end = [], 0
    for a in np.flatnonzero(best).tolist():
        if a < end:
            continue
        kind, end = (int(best[a]) - 1) // 2, a + 1
        while end < len(text) and best[end] == 2 + 2 * kind:
            end += 1
        b = end
        if not _near_triggers(text, a, b):
            continue
        while a < b and text[a].isspace():
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:!?"):
            b -= 1
        if b - a < 6:
            continue
        cuts_word = (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())
        if not cuts_word:
            found.append((a, kind, b))
    return found


def fits(value: str, kind: int) -> bool:
    """Whether a text can be a value of a kind, its separators undone."""
    if kind == 0:
        return EMAIL.fullmatch(DOT.sub(".", AT.sub("@", value))) is not None
    parts, signs = re.findall("[0-9]+", value), {s.strip() for s in re.split("[0-9]+", value)[1:-1]}
    digits = "".join(parts)
    if not digits.isascii() or (re.search("[A-Za-z]", value) and not (kind == 1 and DOT.search(value))):
        return False
    if kind == 1:
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and len(signs) == 1 and signs != {""}
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and len(signs) <= 1
    # addresses of machines, years, book numbers, and numbers with signs that lists, clocks and coordinates have, are none
    years = all(len(p) == 4 and "1800" <= p <= "2199" for p in parts)
    return 10 <= len(digits) <= 15 and 2 <= len(parts) <= 6 and not years and not fits(value, 1) and not re.search("[,;:]", value) and not (len(digits) == 13 and digits[:3] in ("978", "979"))


def settled(text: str, span: Span) -> Span | None:
    """The span, if its value can be of its kind; else the whole address or numbers that it is a part of, if these can; else
    as an address, ip or card, if it can be one."""
    a, kind, b = span
    if fits(text[a:b], kind):
        return span
    lo = max(0, a - WINDOW)
    whole = next((m for m in (NUMBERS if kind else ADDRESS).finditer(text, lo, min(len(text), b + WINDOW)) if m.end() > a), None)
    ends = [(a, b)] if whole is None or whole.start() >= b else [whole.span(), (a, b)]
    for k in (kind, *range(3)):
        for x, y in ends:
            cuts_word = (x > 0 and text[x - 1].isalnum() and text[x].isalnum()) or (y < len(text) and text[y].isalnum() and text[y - 1].isalnum())
            if not cuts_word and fits(text[x:y], k):
                return x, k, y
    return None


def merged(base: list[Span], tagged: list[Span]) -> list[Span]:
    """All base spans, and the tagged ones that touch none of them (both in order of start)."""
    ends = sorted(base, key=lambda s: s[0])
    starts = [s[0] for s in ends]
    reach: list[int] = []
    for s in ends:
        reach.append(max(s[2], reach[-1] if reach else 0))
    added = []
    for a, k, b in tagged:
        before = bisect.bisect_left(starts, b)
        if not before or reach[before - 1] <= a:
            added.append((a, k, b))
    return sorted(base + added)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, the number of base spans by kind, ``base`` and ``spans`` (base and tagged ones), joined."""
    kind = docs.schema[id_col].dataType.simpleString()

    def search(frame: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [t or "" for t in frame["_text"].to_pylist()]
        places = [windows(t) if tagger else [] for t in texts]
        tags = tagger.tag([texts[i][s : s + WINDOW] for i, p in enumerate(places) for s in p]) if tagger else []
        bases, spans, at = [], [], 0
        for text, starts in zip(texts, places, strict=True):
            base = base_spans(text)
            tagged = [t for s in reconcile(text, starts, tags[at : at + len(starts)]) if (t := settled(text, s))]
            at += len(starts)
            bases.append(base)
            spans.append(merged(base, tagged))
        out = {"_id": frame["_id"]}
        out |= {f"n_{k}": pa.array([sum(s[1] == i for s in base) for base in bases], pa.int64()) for i, k in enumerate(KINDS)}
        return out | {"base": pa.array(map(joined, bases), pa.string()), "spans": pa.array(map(joined, spans), pa.string())}

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return by_batch(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), lambda: search, f"_id {kind}, {counts}, base string, spans string")


def op4_query(docs: DataFrame) -> DataFrame:
    found = scan(docs, fit(docs))
    return found.select(F.col("_id").alias("doc_id"), *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
