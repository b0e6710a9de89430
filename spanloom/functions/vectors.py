"""Column helpers for vectors held as arrays; arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = F.lit


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine with the product of norms held at eps at least, so a zero vector gives 0."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    n = norm(v)
    return F.when(n < eps, v).otherwise(F.transform(v, lambda x: x / n))


def round_half_away(x: Column, digits: int = 6) -> Column:
    """A double rounded as C and SQL engines do: x * 10^digits to a whole number, halves away from zero, and a zero keeps its sign (F.round goes by decimal digits and drops the sign)."""
    y = x * F.lit(10.0**digits)
    whole = F.rint(y)
    whole = F.when(F.abs(y - whole) == 0.5, y + F.signum(y) * 0.5).otherwise(whole)
    return F.when(F.abs(y) < float("inf"), whole / F.lit(10.0**digits)).otherwise(x)


def rounded(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: round_half_away(x, digits))


def linspace(a: Column | float, b: Column | float, n: Column) -> Column:
    """n evenly spaced numbers from a to b; [a] for n = 1."""
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
    step = (b - a) / F.greatest(n - 1, F.lit(1))
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), lambda i: a + i * step))


def linspace_int(a: Column | float, b: Column | float, n: Column) -> Column:
    return F.transform(linspace(a, b, n), lambda x: x.cast("long"))


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.least(F.greatest(x, lo), hi)
