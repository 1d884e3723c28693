"""float64 semantics on Spark columns.

ANSI SQL raises or returns NULL where IEEE arithmetic gives infinities and NaN, and orders NaN above all.
Everything a formula computes goes through these helpers; no NULL may enter them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
_LOW, _HIGH = -(2.0**63), 2.0**63 - 1024  # doubles that a BIGINT can hold


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def truth(x: Column) -> Column:
    """NumPy's x != 0: NaN is true."""
    return F.isnan(x) | (x != F.lit(0.0))


def flag(condition: Column) -> Column:
    return condition.cast("double")


def divide(a: Column, b: Column) -> Column:
    """a / b; a zero denominator gives NaN or an infinity by the signs, that of a negative zero included."""
    negative = (a < 0) != (F.atan2(b, F.lit(-1.0)) < 0)
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.when(negative, F.lit(-INF)).otherwise(F.lit(INF)))
    return F.when(F.isnan(b), F.lit(NAN)).when(b == 0, at_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def logarithm(x: Column, of) -> Column:
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(of(F.when(x > 0, x).otherwise(F.lit(1.0))))


def _whole(x: Column, of) -> Column:
    """Floor or ceiling as a double: numbers of 2**52 or more, infinities and NaN are themselves."""
    small = ~F.isnan(x) & (F.abs(x) < F.lit(2.0**52))
    return F.when(small, of(F.when(small, x).otherwise(F.lit(0.0))).cast("double")).otherwise(x)


def floor(x: Column) -> Column:
    return _whole(x, F.floor)


def ceil(x: Column) -> Column:
    return _whole(x, F.ceil)


def trunc(x: Column) -> Column:
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def rounded(x: Column, digits: int = 0) -> Column:
    """Half to even on the scaled double."""
    if not digits:
        return F.rint(x)
    scale = F.lit(10.0 ** abs(digits))
    return F.rint(x * scale) / scale if digits > 0 else F.rint(x / scale) * scale


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of b; NaN for a zero divisor or an infinite dividend."""
    safe = F.when((b == 0) | F.isnan(b), F.lit(1.0)).otherwise(b)
    rest = a % safe
    rest = F.when((rest != 0) & ((rest < 0) != (safe < 0)), rest + safe).otherwise(rest)
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == F.lit(INF)), F.lit(NAN)).otherwise(rest)


def least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(a, b))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return least(greatest(x, low), high)


def compare(op: str, a: Column, b: Column) -> Column:
    """A boolean: with a NaN operand only != holds."""
    known = ~F.isnan(a) & ~F.isnan(b)
    return {
        "<": known & (a < b), "<=": known & (a <= b), ">": known & (a > b), ">=": known & (a >= b), "==": known & (a == b), "!=": ~known | (a != b),
    }[op]


def as_long(x: Column) -> Column:
    """Rounded half to even and clipped to BIGINT; 0 where it isn't finite (the caller guards)."""
    r = F.rint(F.when(finite(x), x).otherwise(F.lit(0.0)))
    return F.when(r >= F.lit(2.0**63), F.lit(2**63 - 1)).when(r <= F.lit(_LOW), F.lit(-(2**63))).otherwise(F.least(F.greatest(r, F.lit(_LOW)), F.lit(_HIGH)).cast("long"))


def bitwise(op: str, a: Column, b: Column) -> Column:
    x, y = as_long(a), as_long(b)
    return F.when(finite(a) & finite(b), {"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op].cast("double")).otherwise(F.lit(NAN))


def shift(op: str, a: Column, b: Column) -> Column:
    x, y = as_long(a), as_long(b)
    count = F.when((y >= 0) & (y <= 63), y).otherwise(F.lit(0)).cast("int")
    done = F.call_function("shiftleft" if op == "<<" else "shiftright", x, count)
    return F.when(finite(a) & finite(b) & (y >= 0) & (y <= 63), done.cast("double")).otherwise(F.lit(NAN))


def invert(a: Column) -> Column:
    return F.when(finite(a), F.bitwise_not(as_long(a)).cast("double")).otherwise(F.lit(NAN))


def to_null(x: Column) -> Column:
    """For output: NaN becomes NULL."""
    return F.when(~F.isnan(x), x)
