"""Ordered rules as column expressions: the first rule that holds gives the value."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_pattern(pattern: str) -> str:
    """The pattern for ``rlike``: case ignored, and each \\b a boundary of ASCII words (Java's knows other letters)."""
    out = re.sub(r"\\b(?=\w)", r"(?<![A-Za-z0-9_])", pattern)
    return "(?i)" + out.replace(r"\b", "(?![A-Za-z0-9_])")


def _cases(cases: Iterable[tuple[Column, object]], default: Column) -> Column:
    out = None
    for when, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(when, value) if out is None else out.when(when, value)
    return default if out is None else out.otherwise(default)


def _contains(low: Column, needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(n) for n in needles])


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def literals(pattern: str) -> list[str] | None:
    """Lower-cased texts of which one stands in all that the pattern can be found in; None where that cannot be told."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(pattern + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
    found = [re.match(r"(?:\\b)?([A-Za-z0-9 -]*)(.?)", p) for p in parts]
    # what a sign of repetition follows need not be there
    texts = [m[1][:-1] if m[2] in ("?", "*", "{") and m[2] else m[1] for m in found]
    return [t.lower() for t in texts] if all(len(t) > 1 for t in texts) else None


def first_match(col: Column, rules: Sequence[tuple[str, str]], default: Column | str | None = None, lower: Column | None = None) -> Column:
    """Value of the first pattern that is found; a null text matches none. ``lower``: the lower-cased text, for long ones;
    a pattern is only tried where one of its literals stands."""

    def holds(pattern: str) -> Column:
        found, needles = col.rlike(java_pattern(pattern)), literals(pattern)
        return found if lower is None or not needles else _contains(lower, needles) & found

    return _cases(((holds(p), v) for p, v in rules), _column(default))


def exact_map(col: Column, mapping: Mapping[str, str], default: Column | str | None = None) -> Column:
    return _cases(((col == k, v) for k, v in mapping.items()), _column(default))


def contains_rules(col: Column, rules: Sequence[tuple[Sequence[str], str]], default: Column | str | None = None, lower: Column | None = None) -> Column:
    """Value of the first rule of which the lower-cased text contains a needle."""
    low = F.lower(col) if lower is None else lower
    return _cases(((_contains(low, n), v) for n, v in rules), _column(default))


def code_map_with_override(code: Column, text: Column, overrides: Sequence[tuple[str, str]], mapping: Mapping[str, str], default: str) -> Column:
    """Patterns on a text come before the map of codes."""
    return first_match(text, overrides, exact_map(code, mapping, default))
