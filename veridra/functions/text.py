"""Column functions that the cleaning steps share: text as the reference semantics read it, padding, numbers, let."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
_STRIP = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def text(c: Column) -> Column:
    """The stripped text of a value; null reads as empty."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def zfill(c: Column, width: int) -> Column:
    """Zeros in front up to the width, after a sign; longer text stays."""
    sign = F.when(c.rlike(r"^[+-]"), F.substring(c, 1, 1)).otherwise("")
    rest = F.substr(c, F.length(sign) + 1)
    missing = F.lit(width) - F.length(c)
    return F.when(missing > 0, F.concat(sign, F.repeat(F.lit("0"), missing.cast("int")), rest)).otherwise(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def number(c: Column) -> Column:
    """Text as a double; null unless it is written as a plain number (so no suffixes, words or blanks)."""
    plain = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    value = c.cast("string")
    return F.when(value.rlike(plain), strip(value).try_cast("double"))


def true(predicate: Column) -> Column:
    """The predicate with unknown read as false."""
    return F.coalesce(predicate, F.lit(False))


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str]:
    source, target = [], []
    for c in map(chr, range(0x80, min(0x2000, sys.maxunicode))):
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if plain != c and len(plain) == 1:
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target)


def fold(c: Column) -> Column:
    """Upper case with accents taken off."""
    source, target = _folds()
    return F.regexp_replace(F.translate(F.upper(c), source, target), r"\p{Mn}", "")


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The entry of a small fixed table; null where there is none."""
    if not table:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def part(c: Column, at: int, size: int) -> Column:
    """Digits at a fixed place as a number."""
    return F.substring(c, at, size).try_cast("int")


def month_number(c: Column) -> Column:
    """1 to 12 of an English three-letter name in any case, else null."""
    at = F.call_function("instr", F.lit(MONTHS), F.upper(c))
    return F.when((F.length(c) == 3) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def stamp(year, month, day, hour=0, minute=0, second=0) -> Column:
    """A wall-clock time, null where the date can't be."""
    cols = [x if isinstance(x, Column) else F.lit(x) for x in (year, month, day, hour, minute, second)]
    return F.try_make_timestamp_ntz(*cols)


def two_digit_year(c: Column) -> Column:
    return F.when(c >= 69, c + 1900).otherwise(c + 2000)
