"""Element-wise operators as plain Column functions.

Inputs are finite-or-null doubles (or nullable conditions).  Operators that can leave the finite
range end in `finite`; the others keep it by construction and skip the extra test.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .guards import finite, is_finite as _is_finite, ratio


def add(a: Column, b: Column) -> Column:
    return finite(a + b)


def subtract(a: Column, b: Column) -> Column:
    return finite(a - b)


def multiply(a: Column, b: Column) -> Column:
    return finite(a * b)


def divide(a: Column, b: Column) -> Column:
    return finite(ratio(a, b))


def _both(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def minimum(a: Column, b: Column) -> Column:
    return F.when(_both(a, b), F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    return F.when(_both(a, b), F.greatest(a, b))


def neg(a: Column) -> Column:
    return -a


def absolute(a: Column) -> Column:
    return F.abs(a)


def sign(a: Column) -> Column:
    return F.signum(a)


def log(a: Column) -> Column:
    return F.when(a > 0, F.ln(a))


def log1p(a: Column) -> Column:
    return F.when(a > -1, F.log1p(a))


def sqrt(a: Column) -> Column:
    return F.when(a >= 0, F.sqrt(a))


def exp(a: Column) -> Column:
    return finite(F.exp(a))


def power(a: Column, p: float) -> Column:
    return finite(F.when((a != 0) | F.lit(p > 0), F.pow(a, F.lit(float(p)))))


def signed_power(a: Column, p: float) -> Column:
    grown = F.signum(a) * F.pow(F.abs(a), F.lit(float(p)))
    return finite(F.when((a != 0) | F.lit(p > 0), grown))


def clip(a: Column, low: float, high: float) -> Column:
    bounded = F.least(F.greatest(a, F.lit(float(low))), F.lit(float(high)))
    return F.when(a.isNotNull(), bounded)


def lt(a: Column, b: Column) -> Column:
    return a < b


def le(a: Column, b: Column) -> Column:
    return a <= b


def gt(a: Column, b: Column) -> Column:
    return a > b


def ge(a: Column, b: Column) -> Column:
    return a >= b


def eq(a: Column, b: Column) -> Column:
    return a == b


def ne(a: Column, b: Column) -> Column:
    return a != b


def both(a: Column, b: Column) -> Column:
    """AND in which any unknown makes the result unknown."""
    return F.when(_both(a, b), a & b)


def either(a: Column, b: Column) -> Column:
    """OR in which any unknown makes the result unknown."""
    return F.when(_both(a, b), a | b)


def negate(a: Column) -> Column:
    return ~a


def if_then_else(c: Column, x: Column, y: Column) -> Column:
    return F.when(c.isNotNull(), F.when(c, x).otherwise(y))


def is_finite(a: Column) -> Column:
    return _is_finite(a)


def fillna(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)
