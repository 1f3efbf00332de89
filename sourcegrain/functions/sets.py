"""Similarities of token sets held as arrays of distinct strings; all are plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_set(text: Column, pattern: str = "[a-z0-9]+", stop: tuple[str, ...] = (), shortest: int = 1) -> Column:
    """Distinct tokens of lower-cased text, sorted; null text has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    if shortest > 1:
        words = F.filter(words, lambda w: F.length(w) >= shortest)
    words = F.array_distinct(words)
    if stop:
        words = F.array_except(words, F.array(*[F.lit(w) for w in stop]))
    return F.sort_array(words)


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def longer_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set; 0 where a side is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared(a, b) / F.greatest(F.size(a), F.size(b)))


def share_of_first(a: Column, b: Column) -> Column:
    """How much of a stands in b; 0 where a is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(shared(a, b) / F.size(a))


def dice(a: Column, b: Column) -> Column:
    return F.when(F.size(a) + F.size(b) == 0, 0.0).otherwise(2.0 * shared(a, b) / (F.size(a) + F.size(b)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
