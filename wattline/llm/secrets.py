r"""Secrets in texts and in what is encoded in them.

Every text is a worklist of layers, starting with itself. A layer is searched
for secrets and for encoded parts: percent and Unicode escapes give a layer in
which all of them are undone, base64 runs and the compressed data in them give a
layer each. That goes on until no layer is new (a layer that was seen before
at the same place is not searched again, which ends cycles). Each layer knows for each of its
characters which part of the text it stands for, so finds are given as spans of
the text.

Edge cases: a null text is empty; finds that map to the same kind and span count
once; encoded data that is not UTF-8 is read as Latin-1; the searches take time
in proportion to the text and to what it unfolds to; a compressed part is
searched ``MAX_UNFOLDED`` bytes at a time; base64 may begin behind a path or
prefix, and may be wrapped in lines; other columns are not read.

In scope are: percent escapes; the escapes ``\u``, ``\u{}``, ``\U`` and ``\x``; numeric character references; base64 of
both alphabets, in lines of 40 characters and more (the last one followed by nothing in its line) or unbroken; in it gzip (of several members), zlib and deflate data, UTF-8
and UTF-16. Out of scope are: named references, octal escapes, other bases than 64, base64 in lines of under 40 characters
or behind quote marks as a whole (its lines are searched one by one), other compressions, and encryption.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

#: Fixed values of the contract: the kinds in their order, and their forms.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

#: Bytes that are unfolded and searched at once, and those of them that are searched again with the next ones.
MAX_UNFOLDED, OVERLAP = 1 << 26, 1 << 16
ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,2})?")
SEPARATOR = re.compile(r"[/_-]")
STANDARD = str.maketrans("-_", "+/")
#: The second bytes of zlib data whose first is x.
ZLIB = (b"\x01", b"\x5e", b"\x9c", b"\xda")
#: base64 in lines of 40 characters and more.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+(?![^\r\n=]))+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

Span = tuple[int, int, int]


def direct(text: str, has_run: bool = True) -> list[Span]:
    """(start, kind, end) of the secrets that stand in a text as they are. ``has_run``: it may hold a run of 24 hex digits."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if has_run:
        # runs of hex digits are as long as they get, so the shorter ones need no visit
        found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def _undo(escape: str) -> list[tuple[str, int, int]]:
    """(character, start, end) inside an escape."""
    if escape[0] == "%" or escape.startswith("\\x"):
        step = 3 if escape[0] == "%" else 4
        data = bytes(int(escape[i + step - 2 : i + step], 16) for i in range(0, len(escape), step))
        try:
            decoded = data.decode()
        except UnicodeDecodeError:
            decoded = data.decode("latin-1")
            return [(c, i * step, (i + 1) * step) for i, c in enumerate(decoded)]
        out, at = [], 0
        for c in decoded:
            n = len(c.encode())
            out.append((c, at * step, (at + n) * step))
            at += n
        return out
    if escape.startswith("\\u") and "{" not in escape:
        units = [int(escape[i + 2 : i + 6], 16) for i in range(0, len(escape), 6)]
        out, i = [], 0
        while i < len(units):
            n = 2 if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000 else 1
            code = 0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00 if n == 2 else units[i]
            out.append((chr(code), i * 6, (i + n) * 6))
            i += n
        return out
    digits = escape.strip("\\uU{}&#;")
    code = int(digits[1:], 16) if digits[:1] in ("x", "X") else int(digits, 10 if escape[0] == "&" else 16)
    return [(chr(code) if code < 0x110000 else "�", 0, len(escape))]


def _unescaped(text: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The text with all escapes undone, and where each of its characters starts and ends in the given one."""
    chars, starts, ends, at = [], [], [], 0
    for m in ESCAPE.finditer(text):
        chars.append(text[at : m.start()])
        plain = np.arange(at, m.start())
        new = _undo(m.group())
        chars += [c for c, _, _ in new]
        starts += [plain, np.array([m.start() + a for _, a, _ in new], np.int64)]
        ends += [plain + 1, np.array([m.start() + b for _, _, b in new], np.int64)]
        at = m.end()
    if not at:
        return None
    plain = np.arange(at, len(text))
    return "".join([*chars, text[at:]]), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1])


def _unfold(data: bytes) -> Iterator[bytes]:
    """What gzip, zlib or raw deflate data holds, MAX_UNFOLDED bytes at a time, as far as it is whole; of gzip and zlib data
    one member after the other."""
    for bits in (47, -15):
        rest, some = data, False
        try:
            while rest:
                unfolder = zlib.decompressobj(bits)
                while out := unfolder.decompress(rest, MAX_UNFOLDED):
                    some = True
                    yield out
                    rest = unfolder.unconsumed_tail
                rest = unfolder.unused_data if unfolder.eof and bits > 0 else b""
        except zlib.error:
            pass
        if some:
            return


def _wide(data: bytes) -> str | None:
    """The text of UTF-16 data: such as begins with a byte order mark, or has a NUL in most pairs, always on one side."""
    data = data[: len(data) // 2 * 2]
    if len(data) < 4:
        return None
    low, high = data[1::2].count(0), data[::2].count(0)
    marked = data[:2] in (b"\xff\xfe", b"\xfe\xff")
    kind = "utf-16" if marked else "utf-16-le" if not high and 2 * low > len(data) // 2 else "utf-16-be" if not low and 2 * high > len(data) // 2 else None
    try:
        return kind and data.decode(kind)
    except UnicodeDecodeError:
        return None


def _is_plain(text: str) -> bool:
    return text.isprintable() or all(c.isprintable() or c in "\t\n\r" for c in text)


def _payload(data: bytes) -> Iterator[str]:
    """The texts that bytes stand for: themselves (as Latin-1 where they are not UTF-8), or what they unfold to, as often
    as they are folded. What is too large for one text comes in several that overlap."""
    seen: set[bytes] = set()
    while data not in seen:
        seen.add(data)
        if text := _wide(data):
            yield text
            return
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = data.decode("latin-1")
        parts = iter(()) if _is_plain(text) else _unfold(data)
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += len(part)
            if size > MAX_UNFOLDED:
                break
        else:
            if not held:
                yield text
                return
            data = b"".join(held)
            continue
        rest = b""
        for part in chain(held, parts):
            yield (rest + part).decode("utf-8", "replace")
            rest = part[-OVERLAP:]
        return


def _bytes(body: str) -> bytes:
    """base64 without its padding; a last character that is too much is left out."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _plain_from(data: bytes) -> int:
    """Where the plain text begins that data ends with."""
    text = data.decode("utf-8", "surrogateescape")
    at = len(text)
    while at and (text[at - 1].isprintable() or text[at - 1] in "\t\n\r"):
        at -= 1
    return len(text[:at].encode("utf-8", "surrogateescape"))


def _decoded(run: str) -> Iterator[tuple[int, str]]:
    """(start in the run, text) for what a base64 run stands for. If it is not UTF-8 or folded data from its start, it
    may begin behind a path or a prefix: the first / - or _ that plain text or folded data follows is taken. If there
    is none, the run is read at all four offsets."""
    body = run.rstrip("=").translate(STANDARD)
    at = [_bytes(body[k:]) for k in range(4)]
    if len(body) % 4 != 1 and (text := _wide(at[0])):
        yield 0, text
        return
    try:
        if len(body) % 4 != 1 and (text := at[0].decode()):
            yield 0, text
            return
    except UnicodeDecodeError:
        pass
    plain = [_plain_from(data) for data in at]
    for s in [0, *(m.end() for m in SEPARATOR.finditer(run))]:
        skip = s // 4 * 3
        if len(body) - s < 16:
            break
        if (s == 0 or plain[s % 4] <= skip) and len(body) % 4 != (s + 1) % 4:
            data = at[s % 4][skip:]
            folded = next(_unfold(data), None) if plain[s % 4] > skip else None
            if folded or plain[s % 4] <= skip:
                yield from ((s, text) for text in _payload(data))
                return
        elif at[s % 4][skip : skip + 2] == b"\x1f\x8b" or (at[s % 4][skip : skip + 1] == b"x" and at[s % 4][skip + 1 : skip + 2] in ZLIB):
            data = at[s % 4][skip:]
            if next(_unfold(data), None):
                yield from ((s, text) for text in _payload(data))
                return
        elif len(body) % 4 != (s + 1) % 4 and (text := _wide(at[s % 4][skip:])):
            yield s, text
            return
    for data in at:
        yield 0, data.decode("latin-1")


def _wrapped(layer: str) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Lines (start, end) of base64 that was wrapped, and their bytes, where these are plain text or hold folded data or
    UTF-16: all lines but the last are equally long."""
    for m in WRAPPED.finditer(layer):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in LINE.finditer(m.group())]
        width = lines[0][1] - lines[0][0]
        full = next((i for i, (a, b) in enumerate(lines) if b - a != width), len(lines))
        if width % 4:
            continue
        for n in (full + 1, full) if full < len(lines) and lines[full][1] - lines[full][0] < width else (full,):
            body = "".join(layer[a:b] for a, b in lines[:n]).rstrip("=").translate(STANDARD)
            if n > 1 and len(body) % 4 != 1:
                data = _bytes(body)
                if not _plain_from(data) or _wide(data) or next(_unfold(data), None):
                    yield lines[:n], data
                    break


def _joined_lines(lines: list[tuple[int, int]], data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The texts of wrapped base64, and for each character the start and end of the lines that it stands in."""
    for text in _payload(data):
        if _plain_from(data):
            yield text, np.full(len(text), lines[0][0]), np.full(len(text), lines[-1][1])
        else:
            ends = np.cumsum([len(c.encode()) for c in text])
            starts = np.concatenate([[0], ends[:-1]])
            width = lines[0][1] - lines[0][0]
            of = np.array(lines)
            yield text, of[starts * 4 // 3 // width, 0], of[(ends * 8 - 1) // 6 // width, 1]


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """The direct finds, and all finds, both as (start, kind, end)."""
    text = text or ""
    base: list[Span] = []
    found: set[Span] = set()
    seen: set[tuple[bytes, tuple[int, int] | None]] = set()
    work = deque([(text, None, None, None)])
    while work:
        layer, lo, hi, place = work.popleft()
        # equal layers at two places are two layers
        mark = (hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest(), place)
        if mark in seen:
            continue
        seen.add(mark)
        runs = [(m.start(), m.end(), m.group()) for m in RUN.finditer(layer)]
        here = direct(layer, any(b - a >= 24 for a, b, _ in runs))
        if lo is None:
            base = here
            found.update(here)
        else:
            found.update((int(lo[a]), k, int(hi[b - 1])) for a, k, b in here)
        spot = (lambda a, b: (a, b)) if lo is None else (lambda a, b: (int(lo[a]), int(hi[b - 1])))
        if "%" in layer or "\\" in layer or "&#" in layer:
            if new := _unescaped(layer):
                plain, starts, ends = new
                work.append((plain, starts if lo is None else lo[starts], ends if lo is None else hi[ends - 1], place))
        inside: set[int] = set()
        for lines, data in _wrapped(layer) if "\n" in layer else ():
            inside.update(a for a, _ in lines)
            place_of = spot(lines[0][0], lines[-1][1])
            for decoded, starts, ends in _joined_lines(lines, data):
                work.append((decoded, starts if lo is None else lo[starts], ends if lo is None else hi[ends - 1], place_of))
        for a, b, run in runs:
            if a in inside:
                continue
            for skip, decoded in _decoded(run):
                start, end = spot(a + skip, b)
                work.append((decoded, np.full(len(decoded), start), np.full(len(decoded), end), (start, end)))
    return base, sorted(found)


def joined(spans: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, the number of direct finds by kind, ``base`` (direct finds) and ``spans`` (all), joined."""
    kind = docs.schema[id_col].dataType.simpleString()

    def search(frame: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [find(text) for text in frame["_text"].to_pylist()]
        out = {"_id": frame["_id"]}
        out |= {f"n_{k}": pa.array([sum(s[1] == i for s in base) for base, _ in found], pa.int64()) for i, k in enumerate(KINDS)}
        return out | {"base": pa.array([joined(base) for base, _ in found], pa.string()), "spans": pa.array([joined(spans) for _, spans in found], pa.string())}

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return by_batch(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), lambda: search, f"_id {kind}, {counts}, base string, spans string")


def op8_query(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    return found.select(F.col("_id").alias("doc_id"), *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
