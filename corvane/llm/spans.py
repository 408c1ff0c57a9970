"""Spans (kind, start, end) in code points: base patterns per kind, joining and digests."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

Span = tuple[str, int, int]


def base_spans(text: str, kinds: list[tuple[str, str, Callable[[str], Iterable[re.Match]], Callable[[re.Match], bool]]]) -> list[Span]:
    """Leftmost non-overlapping matches of each kind (name, characters of which a match holds one, finder, test).

    A match that fails its test is dropped, without another try.
    """
    return [(kind, m.start(), m.end()) for kind, needs, find, good in kinds if any(c in text for c in needs) for m in find(text) if good(m)]


def in_order(spans: list[Span], kinds: list[str]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def free_of(spans: list[Span], taken: list[Span]) -> Iterator[Span]:
    """The spans that overlap none of the taken ones."""
    ends, reach = [], []  # of the taken ones by start: the furthest end up to each
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        ends.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    for s in spans:
        before = bisect_left(ends, s[2])
        if not before or reach[before - 1] <= s[1]:
            yield s
