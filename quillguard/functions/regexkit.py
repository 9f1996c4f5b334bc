"""Regular expressions over columns: all matches with their offsets, and folds over matches that overlap.

Offsets are in characters. A match's start is what lies before it: the gaps and the matches so far, so no Python and no
join is needed, and everything stays in one stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MATCH


def empty(kind: str = MATCH) -> Column:
    return F.array().cast(f"array<{kind}>")


def let(x: Column, f) -> Column:
    """f of a value that is computed once: an expression used in several places is otherwise copied to each."""
    return F.element_at(F.transform(F.array(x), f), 1)


def find_all(text: Column, pattern: str, guard: str | None = None) -> Column:
    """array<struct<start,end,text>> of the matches of a pattern that matches no empty string.

    guard: a cheap pattern (or a plain string, if it has no metacharacter) that a text with a match must contain.
    """
    has = text.contains(guard) if guard and guard.isalnum() or guard in ("@", "-", "+", ".") else text.rlike(guard or pattern)
    return F.when(has, _found(text, F.lit(pattern))).otherwise(empty())


def find_all_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """The matches of each pattern in turn. One expression for all, over an array of patterns: shorter plans for long lists."""
    some = F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.rlike(text, p))
    return F.flatten(F.transform(some, lambda p: _found(text, p)))


def _found(text: Column, pattern: Column) -> Column:
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), empty().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["m"].alias("text")))).alias("out"))

    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def first_wins(matches: Column, symmetric: bool) -> Column:
    """Keeps a match unless it overlaps one kept before it.

    The asymmetric test lets a match through that contains an earlier one without sharing an end of it.
    """

    def clash(k: Column, x: Column) -> Column:
        if symmetric:
            return (x["start"] < k["end"]) & (x["end"] > k["start"])
        return ((x["start"] >= k["start"]) & (x["start"] < k["end"])) | ((x["end"] > k["start"]) & (x["end"] <= k["end"]))

    return F.aggregate(matches, empty(), lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(F.concat(acc, F.array(x))))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def alnum_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def by_start(matches: Column) -> Column:
    return F.array_sort(matches)
