"""Sets of columns chosen by name or type when a plan is built."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import Expr, Named


class Selector(Expr):
    """An expression of the columns that pass a test, in the frame's order. `&`, `|`, `~` and `-` between selectors
    are set operations; every other operator works on each column."""

    def __init__(self, test: Callable[[T.StructField], bool]) -> None:
        self.test = test
        super().__init__(lambda ctx: [Named(f.name, F.col(f"`{f.name}`")) for f in ctx.df.schema.fields if test(f)])

    def __and__(self, o):
        return Selector(lambda f: self.test(f) and o.test(f)) if isinstance(o, Selector) else super().__and__(o)

    def __or__(self, o):
        return Selector(lambda f: self.test(f) or o.test(f)) if isinstance(o, Selector) else super().__or__(o)

    def __sub__(self, o):
        return Selector(lambda f: self.test(f) and not o.test(f)) if isinstance(o, Selector) else super().__sub__(o)

    def __invert__(self):
        return Selector(lambda f: not self.test(f))

    def exclude(self, *names: str) -> Selector:
        return Selector(lambda f: self.test(f) and f.name not in names)


def every() -> Selector:
    return Selector(lambda f: True)


def exclude(*names: str) -> Selector:
    return every().exclude(*names)


def starts_with(prefix: str) -> Selector:
    return Selector(lambda f: f.name.startswith(prefix))


def ends_with(suffix: str) -> Selector:
    return Selector(lambda f: f.name.endswith(suffix))


def contains(text: str) -> Selector:
    return Selector(lambda f: text in f.name)


def matches(pattern: str) -> Selector:
    return Selector(lambda f: re.search(pattern, f.name) is not None)


def by_dtype(*kinds: type[T.DataType] | T.DataType) -> Selector:
    return Selector(lambda f: any(isinstance(f.dataType, k) if isinstance(k, type) else f.dataType == k for k in kinds))


def numeric() -> Selector:
    return by_dtype(T.NumericType)


def strings() -> Selector:
    return by_dtype(T.StringType)


def temporal() -> Selector:
    return by_dtype(T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


def lists() -> Selector:
    return by_dtype(T.ArrayType)


def decimals() -> Selector:
    return by_dtype(T.DecimalType)
