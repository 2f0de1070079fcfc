"""How large a piece of text counts: bytes, words, or any measure of one's own that is registered."""

from __future__ import annotations

import re
from collections.abc import Callable

_WORDS = re.compile(r"\S+")

#: A measure gives the size of some bytes. It is monotone: a longer beginning of a text is never smaller.
Measure = Callable[[bytes], int]
_MEASURES: dict[str, Measure] = {"byte": len, "word": lambda part: len(_WORDS.findall(part.decode("utf-8", "replace")))}


def register(name: str, measure: Measure) -> None:
    """A name for a measure; each name is given once."""
    if not name or name in _MEASURES:
        raise ValueError(f"a measure {name!r} is registered" if name else "a measure needs a name")
    _MEASURES[name] = measure


def measure_of(name: str) -> Measure:
    if name not in _MEASURES:
        raise ValueError(f"unit is one of {', '.join(sorted(_MEASURES))}, not {name}")
    return _MEASURES[name]


def furthest(measure: Measure, source: bytes, at: int, end: int, most: int) -> int:
    """The furthest place up to end for which source from `at` on measures at most `most`: doubled steps, then halves."""
    step = 1
    while at + step < end and measure(source[at : at + step]) <= most:
        step *= 2
    low, high = at + step // 2, min(end, at + step)
    if measure(source[at:high]) <= most:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if measure(source[at:middle]) <= most:
            low = middle
        else:
            high = middle
    return low
