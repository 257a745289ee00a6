"""Small text expressions that the stages share."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What is no ASCII letter but equals one when (?iu) ignores case.
ODD_LETTERS = ("\u017f", "\u212a", "\u0131", "\u0130")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def has_any(c: Column, parts: Iterable[str]) -> Column:
    """Whether one of the strings stands in c; null for null."""
    return F.exists(F.array(*map(F.lit, parts)), lambda part: F.contains(c, part))


def folded(c: Column) -> Column:
    """c in lower case, in which a pattern (?iu) finds what it needs as it stands; null where that isn't sure, because a letter
    that isn't ASCII may equal one."""
    return F.when(~has_any(c, ODD_LETTERS), F.lower(c))


def may_match(low: Column, parts: Iterable[str] = (), pattern: str | None = None) -> Column:
    """Whether a folded text has one of the parts or matches the pattern (lower case, both), true where folding isn't sure."""
    tests = ([has_any(low, parts)] if parts else []) + ([low.rlike(pattern)] if pattern else [])
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(True))


def strip(c: Column) -> Column:
    """Without white space (Unicode) at either end; SQL trim knows spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_whole(c: Column) -> Column:
    """strip for long texts, which seldom need it."""
    return let(c, lambda t: F.when(F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(r"(?U)\s"), strip(t)).otherwise(t))


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches as an array; empty for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def replace_each(c: Column, found: Column, to: Column | str) -> Column:
    """Every literal of found, in order, replaced wherever it stands."""
    to = F.lit(to) if isinstance(to, str) else to
    return F.aggregate(found, c, lambda text, x: F.replace(text, x, to))


def squeeze(c: Column) -> Column:
    """Lower case with single spaces: the form in which duplicates are compared."""
    return strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def compact(*items: Column) -> Column:
    """The items that are not null, as an array, in order."""
    return F.array_compact(F.array(*items))


def percent(c: Column) -> Column:
    """0.125 as 12%: half goes to even."""
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def chain(c: Column, pairs: tuple[tuple[str, str], ...], flags: str) -> Column:
    """Replacements one after the other."""
    return reduce(lambda text, pair: sub(text, flags + pair[0], pair[1]), pairs, c)


def plural(n: Column) -> Column:
    return F.when(n != 1, "s").otherwise("")


def fixed(c: Column, places: int) -> Column:
    """A number with that many decimals, half to even; no grouping."""
    return F.call_function("format_number", c, F.lit(f"0.{'0' * places}"))


def rounded(c: Column, places: int) -> Column:
    """Rounded on the exact binary value, half to even; round() goes by the shortest decimal, half up."""
    return fixed(c, places).cast("double")


def sql_round(c: Column, places: int) -> Column:
    """Rounded as DuckDB does, half away from zero after scaling. Ties come out otherwise in round(), and zero loses its sign
    there: -0.0000003 is told as -0.0000."""
    near = F.round(c * 10.0**places) / 10.0**places
    return F.when(near == 0, c * 0.0).otherwise(near)
