"""Per-pixel arithmetic with IEEE and Java rules, as Column functions.

Band expressions are written as Columns; these functions give the rules of the
reference's expression language where Spark's own operators differ: division by
zero, comparisons with NaN, logarithms of what isn't positive, rounding half up,
saturating casts and wrapping integers. All stay inside code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _d(c) -> Column:
    return c.cast("double") if isinstance(c, Column) else F.lit(float(c))


def div(a, b) -> Column:
    """a/b of doubles: by zero it is infinite, with the zero's sign, or NaN for 0/0 and NaN/0; missing where one is."""
    a, b = _d(a), _d(b)
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b != 0, b))


def int_div(a: Column, b: Column) -> Column:
    """a/b of ints, towards zero; null by zero. The least int by -1 wraps to itself."""
    return F.when((a == -2147483648) & (b == -1), a).otherwise((a.cast("double") / F.when((b != 0) & ~((a == -2147483648) & (b == -1)), b)).cast("int"))


def mod(a, b) -> Column:
    a, b = _d(a), _d(b)
    return F.when(a.isNotNull() & (b == 0), F.lit(NAN)).otherwise(a % F.when(b != 0, b))


def _cmp(test):
    def compare(a, b) -> Column:
        a, b = _d(a), _d(b)
        return ~F.isnan(a) & ~F.isnan(b) & test(a, b)

    return compare


lt, le, gt, ge, eq = (_cmp(t) for t in (lambda a, b: a < b, lambda a, b: a <= b, lambda a, b: a > b, lambda a, b: a >= b, lambda a, b: a == b))


def ne(a, b) -> Column:
    return ~eq(a, b)


def log(a) -> Column:
    a = _d(a)
    return F.when(F.isnan(a) | (a < 0), F.lit(NAN)).when(a == 0, F.lit(-INF)).otherwise(F.log(F.when(a > 0, a)))


def log10(a) -> Column:
    a = _d(a)
    return F.when(F.isnan(a) | (a < 0), F.lit(NAN)).when(a == 0, F.lit(-INF)).otherwise(F.log10(F.when(a > 0, a)))


def exp10(a) -> Column:
    return F.pow(F.lit(10.0), _d(a))


def sqr(a) -> Column:
    return _d(a) * _d(a)


def minimum(a, b) -> Column:
    a, b = _d(a), _d(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


def maximum(a, b) -> Column:
    a, b = _d(a), _d(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(a, b))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c within limits; missing where it is, which greatest() and least() alone would make a limit."""
    out = c if high is None else F.least(F.lit(high), c)
    return F.when(c.isNotNull(), out if low is None else F.greatest(F.lit(low), out))


def round_half_up(a) -> Column:
    return F.floor(_d(a) + 0.5).cast("double")


def to_int(a) -> Column:
    """(int) of a double: towards zero, saturating, NaN to 0."""
    a = _d(a)
    return F.when(F.isnan(a), 0).when(a >= 2147483647, 2147483647).when(a <= -2147483648, F.lit(-2147483648).cast("int")).otherwise(F.when(F.abs(a) < 2147483648, a).cast("int"))


def int_add(a, b) -> Column:
    """32-bit sum that wraps."""
    return F.pmod(a.cast("long") + b.cast("long") + F.lit(1 << 31), F.lit(1 << 32)).cast("long") - F.lit(1 << 31)


def ampl(a, b) -> Column:
    return F.sqrt(_d(a) * _d(a) + _d(b) * _d(b))


def phase(a, b) -> Column:
    return F.atan2(_d(b), _d(a))


def feq(a, b, eps: float = 1e-6) -> Column:
    a, b = _d(a), _d(b)
    return eq(a, b) | le(F.abs(a - b), eps)


def fneq(a, b, eps: float = 1e-6) -> Column:
    return ~feq(a, b, eps)


def is_inf(a) -> Column:
    return F.abs(_d(a)) == INF


def sech(a) -> Column:
    return 2 / (F.exp(_d(a)) + F.exp(-_d(a)))


def cosech(a) -> Column:
    return div(F.lit(2.0), F.exp(_d(a)) - F.exp(-_d(a)))


def distance(a: list, b: list) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(reduce(lambda s, t: s + t, (sqr(_d(x) - _d(y)) for x, y in zip(a, b, strict=True))))


def _steps(v: list) -> list[Column]:
    return [_d(v[i + 1]) - _d(v[i]) for i in range(len(v) - 1)]


def _sums(v: list) -> list[Column]:
    out = [_d(v[0])]
    for x in v[1:]:
        out.append(out[-1] + _d(x))
    return out


def distance_deriv(a: list, b: list) -> Column:
    return distance(_steps(a), _steps(b))


def distance_integ(a: list, b: list) -> Column:
    return distance(_sums(a), _sums(b))


def inrange(v: list, low: list, high: list) -> Column:
    """True unless some element lies below or above its bounds; NaN passes."""
    return ~reduce(lambda s, t: s | t, (lt(x, lo) | gt(x, hi) for x, lo, hi in zip(v, low, high, strict=True)))


def inrange_deriv(v: list, low: list, high: list) -> Column:
    return inrange(_steps(v), _steps(low), _steps(high))


def inrange_integ(v: list, low: list, high: list) -> Column:
    return inrange(_sums(v), _sums(low), _sums(high))


def pixel_x() -> Column:
    """X of the pixel's centre."""
    return F.col("x") + 0.5


def pixel_y() -> Column:
    return F.col("y") + 0.5


def flag(raw: Column, mask: int) -> Column:
    """A flag is set if all bits of its mask are."""
    return raw.bitwiseAND(F.lit(mask)) == mask


def fill(value: Column, filler: float) -> Column:
    """NaN and missing values become the filler."""
    return F.when(value.isNull() | F.isnan(value), F.lit(float(filler))).otherwise(value)
