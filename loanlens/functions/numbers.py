"""Scalar functions on numbers: rounding, tolerances, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, n: int = 6) -> Column:
    """Rounds half up and keeps the sign, as IEEE rounding does: a tiny negative number becomes -0.0, not 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    r = F.round(c, n)
    return F.when((r == 0) & (c < 0), -r).otherwise(r)


def close(a: Column, b: Column, relative: float = 0.01) -> Column:
    """Whether two numbers agree relative to the larger; two zeros agree."""
    scale = F.greatest(F.abs(a), F.abs(b))
    return F.when(scale == 0, True).otherwise(F.abs(a - b) / F.nullif(scale, F.lit(0.0)) <= relative)


def larger_split(total: Column, current: Column, deferred: Column) -> Column:
    """A total, or the sum of its two parts where either is known and the sum is larger in size or the total is missing."""
    parts = F.coalesce(current, F.lit(0.0)) + F.coalesce(deferred, F.lit(0.0))
    known = current.isNotNull() | deferred.isNotNull()
    return F.when(known & (total.isNull() | (F.abs(parts) > F.abs(total))), parts).otherwise(total)


def plausible_rate(v: Column) -> Column:
    """The rate if it lies strictly between 0 and 1, else null."""
    return F.when((v > 0) & (v < 1), v)


def looks_rounded(x: Column) -> Column:
    """A multiple of a thousand, of at least a thousand: stored rounded to thousands."""
    return (F.abs(x) >= 1000) & (F.abs(F.bround(x / 1000.0) * 1000.0 - x) < 0.5)


def spread_label(bps: Column) -> Column:
    return F.when(bps.isNull(), "—").otherwise(F.concat(F.lit("S+"), bps.cast("int").cast("string")))


def flags(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, '; ' between them; an unknown test does not hold."""
    return F.concat_ws("; ", *[F.when(test, name) for name, test in tests.items()])
