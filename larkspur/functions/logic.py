"""Conditional and comparison functions with three-valued logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import Col, col


def between(x: Col, low: Col, high: Col) -> Column:
    return col(x).between(col(low), col(high))


def not_between(x: Col, low: Col, high: Col) -> Column:
    """True as soon as one bound definitely fails, even if the other is NULL."""
    return (col(x) < col(low)) | (col(x) > col(high))


def coalesce(*items: Col) -> Column:
    return F.coalesce(*[col(i) for i in items])


def _none_null(items: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [i.isNotNull() for i in items])


def greatest(*items: Col) -> Column:
    """NULL if any argument is."""
    cols = [col(i) for i in items]
    return F.when(_none_null(cols), F.greatest(*cols))


def least(*items: Col) -> Column:
    cols = [col(i) for i in items]
    return F.when(_none_null(cols), F.least(*cols))


def if_(condition: Column, yes: Column, no: Column) -> Column:
    """A NULL condition takes ``no``."""
    return F.when(condition, yes).otherwise(no)


def ifnull(a: Col, b: Col) -> Column:
    return F.ifnull(col(a), col(b))


nvl = ifnull


def nullif(a: Col, b: Col) -> Column:
    return F.nullif(col(a), col(b))


def in_list(x: Col, *items: object) -> Column:
    """NULL in the list: true if found, else NULL."""
    return col(x).isin(*items) if None not in items else F.when(col(x).isin(*[i for i in items if i is not None]), True)


def is_null(x: Col) -> Column:
    return col(x).isNull()


def is_true(b: Column) -> Column:
    return F.coalesce(b, F.lit(False))


def is_false(b: Column) -> Column:
    return F.coalesce(~b, F.lit(False))


def is_not_true(b: Column) -> Column:
    return ~is_true(b)


def is_not_false(b: Column) -> Column:
    return ~is_false(b)


def xor(a: Column, b: Column) -> Column:
    return a != b


def decode_oracle(x: Col, *pairs: object) -> Column:
    """search, result, ..., [default]; NULL matches NULL."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    default = lit(pairs[-1]) if len(pairs) % 2 else F.lit(None)
    out = None
    for k in range(0, len(pairs) - 1, 2):
        test = col(x).eqNullSafe(lit(pairs[k]))
        out = F.when(test, lit(pairs[k + 1])) if out is None else out.when(test, lit(pairs[k + 1]))
    return default if out is None else out.otherwise(default)


def equal_null_safe(a: Col, b: Col) -> Column:
    return col(a).eqNullSafe(col(b))
