"""Column expressions for text: Unicode-aware trimming, lines, searching from a position, naming a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def lines(text: Column) -> Column:
    """The lines of a text; the empty one after a final line end does not count."""
    return let(F.split(text, LINE_END), lambda cut: F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut))


def index_of(text: Column, part: str, start: Column | int = 0) -> Column:
    """The place (from 0) of the first occurrence at start or later, or -1."""
    at = F.lit(start) if isinstance(start, int) else start
    return F.call_function("locate", F.lit(part), text, at + 1) - 1


def last_index_before(text: Column, part: str, end: Column) -> Column:
    """The place of the last occurrence of a character before end, or -1."""
    back = F.instr(F.reverse(F.substring(text, F.lit(1), end)), part)
    return F.when(back > 0, end - back).otherwise(F.lit(-1))


def between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def any_of(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))
