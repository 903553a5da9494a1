"""Deterministic randomness that any SQL engine reproduces: hashes of keys in plain 64-bit arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus (2^31 - 1) and multipliers of the hash.
M, A, B, C = 2147483647, 1103515245, 40692, 48271


def hash31(a: Column, b: Column | int = 0, salt: int = 0) -> Column:
    """An integer in [0, 2^31 - 1) from non-negative keys; no step leaves 62 bits."""
    a = F.pmod(a.cast("long"), F.lit(M).cast("long"))
    b = F.pmod((b if isinstance(b, Column) else F.lit(b)).cast("long"), F.lit(M).cast("long"))
    one = F.pmod(a * A + b * B + salt, F.lit(M).cast("long"))
    two = F.pmod(one * one + one, F.lit(M).cast("long"))
    return F.pmod(two * C + F.lit(7919) * F.pmod(a, F.lit(1000003).cast("long")) + 11, F.lit(M).cast("long"))


def uniform01(a: Column, b: Column | int = 0, salt: int = 0) -> Column:
    """A double in [0, 1) from non-negative keys."""
    return hash31(a, b, salt) / F.lit(float(M))


def hash31_sql(a: str, b: str = "0", salt: int = 0) -> str:
    """The same integer as a SQL expression."""
    a, b = f"(({a}) % {M})", f"(({b}) % {M})"
    one = f"(({a} * {A} + {b} * {B} + {salt}) % {M})"
    two = f"(({one} * {one} + {one}) % {M})"
    return f"(({two} * {C} + 7919 * ({a} % 1000003) + 11) % {M})"


def uniform01_sql(a: str, b: str = "0", salt: int = 0) -> str:
    return f"({hash31_sql(a, b, salt)} / {M}.0::DOUBLE)"
