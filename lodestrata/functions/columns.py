"""Column expressions shared by the operators: time, sets, similarity, keyword tests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def latest(value: Column, order: str = "offset") -> Column:
    return F.max_by(value, F.col(order))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def half_life(age_ms: Column, days: float) -> Column:
    """0.5 ** (age / half life)."""
    return F.pow(F.lit(0.5), age_ms / F.lit(days * DAY_MS))


def tokens(text: Column) -> Column:
    """Lower-case words split at ASCII white space."""
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def hashed_set(text: Column) -> Column:
    """``token_set`` as 64-bit hashes, which compare much faster than words."""
    return F.transform(token_set(text), lambda w: F.xxhash64(w))


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """|a and b| / |a or b| of two arrays of distinct values; the intersection is made once."""
    shared = F.array(F.size(F.array_intersect(a, b)))
    return F.transform(shared, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(both_empty)).otherwise(n / (F.size(a) + F.size(b) - n)))[0]


def rhyme(similarity: Column) -> Column:
    """4 s (1 - s^2), scaled to peak at 1 for s = 1 / sqrt 3."""
    return 4 * similarity * (1 - similarity * similarity) / F.lit(8 / (3 * 3**0.5))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (scale == 0), F.lit(0.0)).otherwise(dot(a, b) / scale)


def count_contained(text: Column, words: Iterable[str]) -> Column:
    """How many of the words are substrings of the text."""
    total = F.lit(0)
    for w in words:
        total = total + text.contains(w).cast("int")
    return total


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return count_contained(text, words) > 0


def first_max(options: Sequence[tuple[str, Column]], default: str) -> Column:
    """Name of the first option whose count is the greatest and above 0."""
    best = F.greatest(*[c for _, c in options])
    out = F.lit(default)
    for name, c in reversed(options):
        out = F.when((c == best) & (c > 0), F.lit(name)).otherwise(out)
    return out


def geometric_mean(factors: Sequence[Column], floor: float) -> Column:
    logs = sum((F.log(F.greatest(F.lit(floor), f)) for f in factors), F.lit(0.0))
    return F.exp(logs / len(factors))


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)
