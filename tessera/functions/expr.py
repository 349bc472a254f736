"""Column expressions that are bound to a frame only when a plan is built.

An expression gives a list of named Spark columns for a context: which frame it is bound to, in which order its rows
are, and what an aggregate means there (a group's value, a value over partitions, or a scalar of the whole frame).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.duration import fixed_micros


@dataclass(frozen=True)
class Context:
    df: DataFrame
    order: tuple[Column, ...] = ()
    #: group: aggregates stand as they are; over: they run over partitions; scalar: they are scalar subqueries.
    mode: str = "group"
    partition: tuple[Column, ...] = ()

    def aggregate(self, column: Column) -> Column:
        if self.mode == "over":
            return column.over(Window.partitionBy(*self.partition))
        return self.df.select(column.alias("value")).scalar() if self.mode == "scalar" else column

    def rows(self):
        """The window that order-dependent expressions run in."""
        if not self.order:
            raise ValueError("row order matters here: give the frame one with ordered_by()")
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def type_of(self, column: Column) -> T.DataType:
        return self.df.select(column.alias("value")).schema[0].dataType


@dataclass(frozen=True)
class Named:
    name: str
    column: Column
    #: Whether an aggregate of the group is in it.
    agg: bool = False
    #: Whether it is a generator, which makes several rows of one.
    rows: bool = False


Resolver = Callable[[Context], list[Named]]


def parse(value: Any) -> Expr:
    """Text names a column; other values are literals."""
    return value if isinstance(value, Expr) else col(value) if isinstance(value, str) else lit(value)


def operand(value: Any) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


class Expr:
    def __init__(self, resolve: Resolver) -> None:
        self.resolve = resolve

    # building blocks

    def map(self, f: Callable[[Column], Column]) -> Expr:
        return self.map_in(lambda c, _: f(c))

    def map_in(self, f: Callable[[Column, Context], Column]) -> Expr:
        return Expr(lambda ctx: [replace(n, column=f(n.column, ctx)) for n in self.resolve(ctx)])

    def reduce(self, f: Callable[[Column, Callable[[Column], Column]], Column]) -> Expr:
        """An aggregate: f gets the column and what to wrap each Spark aggregate in."""

        def resolve(ctx: Context) -> list[Named]:
            inner = [n.column for n in self.resolve(ctx)]
            names = [n.name for n in self.resolve(ctx)]
            return [Named(name, f(c, ctx.aggregate), ctx.mode == "group") for name, c in zip(names, inner)]

        return Expr(resolve)

    def with_(self, others: Sequence[Any], f: Callable[..., Column]) -> Expr:
        """Combine with other operands; one column among them goes with every column of the longest."""
        parts = [self, *map(operand, others)]

        def resolve(ctx: Context) -> list[Named]:
            lists = [p.resolve(ctx) for p in parts]
            n = max(map(len, lists))
            if any(len(x) not in (1, n) for x in lists):
                raise ValueError(f"cannot combine {[len(x) for x in lists]} columns")
            rows = [[x[k % len(x)] for x in lists] for k in range(n)]
            first = next((i for i, x in enumerate(lists) if len(x) == n and x[0].name != "literal"), 0)
            return [Named(r[first].name, f(*[x.column for x in r]), any(x.agg for x in r), any(x.rows for x in r)) for r in rows]

        return Expr(resolve)

    def alias(self, name: str) -> Expr:
        return Expr(lambda ctx: [replace(n, name=name) for n in self.resolve(ctx)])

    # comparison and logic

    def __eq__(self, o):  # type: ignore[override]
        return self.with_([o], lambda a, b: a == b)

    def __ne__(self, o):  # type: ignore[override]
        return self.with_([o], lambda a, b: a != b)

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, o):
        return self.with_([o], lambda a, b: a < b)

    def __le__(self, o):
        return self.with_([o], lambda a, b: a <= b)

    def __gt__(self, o):
        return self.with_([o], lambda a, b: a > b)

    def __ge__(self, o):
        return self.with_([o], lambda a, b: a >= b)

    def __and__(self, o):
        return self.with_([o], lambda a, b: a & b)

    def __or__(self, o):
        return self.with_([o], lambda a, b: a | b)

    def __xor__(self, o):
        return self.with_([o], lambda a, b: a != b)

    def __invert__(self):
        return self.map(lambda c: ~c)

    def is_between(self, low: Any, high: Any) -> Expr:
        return self.with_([low, high], lambda c, a, b: c.between(a, b))

    def is_null(self) -> Expr:
        return self.map(lambda c: c.isNull())

    def is_not_null(self) -> Expr:
        return self.map(lambda c: c.isNotNull())

    def is_nan(self) -> Expr:
        return self.map(lambda c: F.when(c.isNotNull(), F.isnan(c)))

    def is_not_nan(self) -> Expr:
        return self.map(lambda c: F.when(c.isNotNull(), ~F.isnan(c)))

    def is_finite(self) -> Expr:
        return self.map(lambda c: F.when(c.isNotNull(), ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))))

    def is_infinite(self) -> Expr:
        return self.map(lambda c: F.abs(c) == F.lit(float("inf")))

    def is_in(self, values: Sequence[Any]) -> Expr:
        return self.map(lambda c: c.isin(list(values)))

    def fill_null(self, value: Any) -> Expr:
        return self.with_([value], lambda c, v: F.coalesce(c, v))

    def fill_nan(self, value: Any) -> Expr:
        return self.with_([value], lambda c, v: F.nanvl(c, v.cast("double")))

    def cast(self, kind: str | T.DataType, strict: bool = False) -> Expr:
        """Values that can't be cast become null, or raise where strict."""
        return self.map(lambda c: c.cast(kind) if strict else c.try_cast(kind))

    # arithmetic

    def _plus(self, o: Any, flip: bool = False) -> Expr:
        def plus(a: Column, b: Column, ctx: Context) -> Column:
            a, b = (b, a) if flip else (a, b)
            return F.concat(a, b) if isinstance(ctx.type_of(a), T.StringType) else a + b

        other = operand(o)
        return Expr(lambda ctx: self.with_([other], lambda a, b: plus(a, b, ctx)).resolve(ctx))

    def __add__(self, o):
        return self._plus(o)

    def __radd__(self, o):
        return self._plus(o, True)

    def __sub__(self, o):
        return self.with_([o], lambda a, b: a - b)

    def __rsub__(self, o):
        return self.with_([o], lambda a, b: b - a)

    def __mul__(self, o):
        return self.with_([o], lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self.with_([o], divide)

    def __rtruediv__(self, o):
        return self.with_([o], lambda a, b: divide(b, a))

    def __floordiv__(self, o):
        return self.with_([o], lambda a, b: F.floor(F.try_divide(a, b)))

    def __mod__(self, o):
        """The sign of the dividend; null for a zero divisor."""
        return self.with_([o], lambda a, b: a % F.nullif(b, F.lit(0)))

    def __rmod__(self, o):
        return self.with_([o], lambda a, b: b % F.nullif(a, F.lit(0)))

    def __pow__(self, o):
        return self.with_([o], lambda a, b: F.pow(a, b))

    def __neg__(self):
        return self.map(lambda c: -c)

    def abs(self) -> Expr:
        return self.map(F.abs)

    def sqrt(self) -> Expr:
        return self.map(F.sqrt)

    def exp(self) -> Expr:
        return self.map(F.exp)

    def log(self, base: float | None = None) -> Expr:
        """Natural by default; NaN below zero, minus infinity at zero."""
        return self.map(lambda c: F.when(c > 0, F.ln(c) if base is None else F.log(float(base), c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))))

    def round(self, decimals: int = 0) -> Expr:
        return self.map(lambda c: F.round(c, decimals))

    # aggregates

    def sum(self) -> Expr:
        """0 for no values; of booleans, how many are true."""

        def resolve(ctx: Context) -> list[Named]:
            def one(c: Column) -> Column:
                return F.count_if(c) if isinstance(ctx.type_of(c), T.BooleanType) else F.sum(c)

            return [Named(n.name, F.coalesce(ctx.aggregate(one(n.column)), F.lit(0)), ctx.mode == "group") for n in self.resolve(ctx)]

        return Expr(resolve)

    def mean(self) -> Expr:
        return self.reduce(lambda c, w: w(F.avg(c)))

    def min(self) -> Expr:
        return self._extreme(F.min)

    def max(self) -> Expr:
        return self._extreme(F.max)

    def _extreme(self, f: Callable[[Column], Column]) -> Expr:
        """NaN is left out unless there is nothing else."""

        def resolve(ctx: Context) -> list[Named]:
            out = []
            for n in self.resolve(ctx):
                real = isinstance(ctx.type_of(n.column), T.FractionalType) and not isinstance(ctx.type_of(n.column), T.DecimalType)
                value = ctx.aggregate(f(n.column)) if not real else F.coalesce(ctx.aggregate(f(F.when(~F.isnan(n.column), n.column))), ctx.aggregate(f(n.column)))
                out.append(Named(n.name, value, ctx.mode == "group"))
            return out

        return Expr(resolve)

    def count(self) -> Expr:
        return self.reduce(lambda c, w: w(F.count(c)))

    def n_unique(self) -> Expr:
        return self.reduce(lambda c, w: w(F.count_distinct(c)))

    def null_count(self) -> Expr:
        return self.reduce(lambda c, w: w(F.count_if(c.isNull())))

    def var(self, ddof: int = 1) -> Expr:
        if ddof in (0, 1):
            return self.reduce(lambda c, w: w((F.var_samp if ddof else F.var_pop)(c)))
        return self.reduce(lambda c, w: F.when(w(F.count(c)) > ddof, w(F.var_pop(c)) * w(F.count(c)) / (w(F.count(c)) - ddof)))

    def std(self, ddof: int = 1) -> Expr:
        return self.var(ddof).map(F.sqrt)

    def median(self) -> Expr:
        return self.reduce(lambda c, w: w(F.median(c)))

    def quantile(self, q: float, interpolation: str = "nearest") -> Expr:
        """linear, lower, higher, midpoint or nearest (half goes up), of the values in order at (n - 1) * q.

        Spark's percentile counts equal values before it sorts them, and gives linear. The others take the values at
        whole positions: the same aggregate at q plus or minus a part of a step would, but for rounding, so they list
        the group's values; for groups too large for one list use linear.
        """
        if interpolation == "linear":
            return self.reduce(lambda c, w: w(F.percentile(c, q)))

        def at(c: Column, w) -> Column:
            n = w(F.count(c))
            spot = (n - 1) * F.lit(float(q))
            values = F.array_sort(w(F.collect_list(c)))
            pick = lambda k: F.get(values, k.cast("int")).cast("double")
            if interpolation == "midpoint":
                return (pick(F.floor(spot)) + pick(F.ceil(spot))) / 2
            rule = {"lower": F.floor(spot), "higher": F.ceil(spot), "nearest": F.floor(spot + 0.5)}
            return pick(rule[interpolation])

        return self.reduce(at)

    def first(self) -> Expr:
        return self._ends(F.min_by)

    def last(self) -> Expr:
        return self._ends(F.max_by)

    def _ends(self, f) -> Expr:
        def resolve(ctx: Context) -> list[Named]:
            ctx.rows()
            return [Named(n.name, ctx.aggregate(f(F.struct(n.column.alias("v")), F.struct(*ctx.order)))["v"], ctx.mode == "group") for n in self.resolve(ctx)]

        return Expr(resolve)

    def implode(self) -> Expr:
        """A list of the group's values in row order, nulls among them."""

        def resolve(ctx: Context) -> list[Named]:
            return [Named(n.name, gathered(n.column, ctx), ctx.mode == "group") for n in self.resolve(ctx)]

        return Expr(resolve)

    def explode(self) -> Expr:
        return Expr(lambda ctx: [replace(n, column=F.explode_outer(n.column), rows=True) for n in self.resolve(ctx)])

    # windows

    def over(self, *keys: Any) -> Expr:
        """The value in each row's partition: aggregates span it whole, ordered functions follow the frame's order."""

        def resolve(ctx: Context) -> list[Named]:
            by = tuple(n.column for k in keys for n in parse(k).resolve(ctx))
            return [replace(n, agg=False) for n in self.resolve(replace(ctx, mode="over", partition=by))]

        return Expr(resolve)

    def shift(self, n: int = 1) -> Expr:
        return self.map_in(lambda c, ctx: (F.lag(c, n) if n >= 0 else F.lead(c, -n)).over(ctx.rows()))

    def diff(self, n: int = 1) -> Expr:
        return self.map_in(lambda c, ctx: c - (F.lag(c, n) if n >= 0 else F.lead(c, -n)).over(ctx.rows()))

    def forward_fill(self, limit: int = 0) -> Expr:
        """At most `limit` rows after a value; 0: as many as there are."""
        return self.map_in(lambda c, ctx: F.last(c, ignorenulls=True).over(ctx.rows().rowsBetween(-limit if limit else Window.unboundedPreceding, 0)))

    def backward_fill(self, limit: int = 0) -> Expr:
        return self.map_in(lambda c, ctx: F.first(c, ignorenulls=True).over(ctx.rows().rowsBetween(0, limit if limit else Window.unboundedFollowing)))

    def fill_null_strategy(self, strategy: str) -> Expr:
        return {"forward": self.forward_fill, "ffill": self.forward_fill, "backward": self.backward_fill, "bfill": self.backward_fill}[strategy]()

    def _rolling(self, f, window: int | str, min_periods: int) -> Expr:
        rows = int(str(window).removesuffix("i")) if str(window).removesuffix("i").isdigit() else 0
        if rows < 1:
            raise ValueError(f"{window!r} is no number of rows; use the _by form for durations")

        def value(c: Column, ctx: Context) -> Column:
            w = ctx.rows().rowsBetween(1 - rows, 0)
            return F.when(F.count(c).over(w) >= min_periods, f(c).over(w))

        return self.map_in(value)

    def rolling_mean(self, window: int | str, min_periods: int = 1) -> Expr:
        return self._rolling(F.avg, window, min_periods)

    def rolling_sum(self, window: int | str, min_periods: int = 1) -> Expr:
        return self._rolling(F.sum, window, min_periods)

    def rolling_min(self, window: int | str, min_periods: int = 1) -> Expr:
        return self._rolling(F.min, window, min_periods)

    def rolling_max(self, window: int | str, min_periods: int = 1) -> Expr:
        return self._rolling(F.max, window, min_periods)

    def _rolling_by(self, f, window: str | dt.timedelta, by: Any, min_periods: int, closed: str) -> Expr:
        span = fixed_micros(window)
        low, high = {"right": (1 - span, 0), "left": (-span, -1), "both": (-span, 0), "none": (1 - span, -1)}[closed]

        def value(c: Column, ctx: Context) -> Column:
            at = F.unix_micros(parse(by).resolve(ctx)[0].column.cast("timestamp"))
            w = Window.partitionBy(*ctx.partition).orderBy(at).rangeBetween(low, high)
            return F.when(F.count(c).over(w) >= min_periods, f(c).over(w))

        return self.map_in(value)

    def rolling_mean_by(self, window, by, min_periods: int = 1, closed: str = "left") -> Expr:
        return self._rolling_by(F.avg, window, by, min_periods, closed)

    def rolling_sum_by(self, window, by, min_periods: int = 1, closed: str = "left") -> Expr:
        return self._rolling_by(F.sum, window, by, min_periods, closed)

    def rolling_min_by(self, window, by, min_periods: int = 1, closed: str = "left") -> Expr:
        return self._rolling_by(F.min, window, by, min_periods, closed)

    def rolling_max_by(self, window, by, min_periods: int = 1, closed: str = "left") -> Expr:
        return self._rolling_by(F.max, window, by, min_periods, closed)

    # namespaces

    @property
    def str(self):
        from .namespaces import Strings

        return Strings(self)

    @property
    def dt(self):
        from .namespaces import Temporal

        return Temporal(self)

    @property
    def list(self):
        from .namespaces import Lists

        return Lists(self)

    @property
    def struct(self):
        from .namespaces import Structs

        return Structs(self)

    @property
    def name(self):
        from .namespaces import Names

        return Names(self)


def divide(a: Column, b: Column) -> Column:
    """Division of floats as IEEE has it: by zero infinite, or NaN for 0 / 0. Null where either is null."""
    a, b = a.cast("double"), b.cast("double")
    inf = F.lit(float("inf"))
    return F.when(b.isNull() | (b != 0), F.try_divide(a, b)).when((a == 0) | F.isnan(a), F.when(a.isNotNull(), F.lit(float("nan")))).when(a > 0, inf).when(a < 0, -inf)


def gathered(column: Column, ctx: Context) -> Column:
    """All values of a group as a list in row order; collect_list alone would drop nulls."""
    order = [c.alias(f"o{k}") for k, c in enumerate(ctx.order)]
    items = ctx.aggregate(F.collect_list(F.struct(*order, column.alias("value"))))
    return F.transform(F.array_sort(items) if order and ctx.mode != "scalar" else items, lambda x: x["value"])


def col(name: str) -> Expr:
    return Expr(lambda ctx: [Named(name.split(".")[-1], F.col(name if "." in name else f"`{name}`"))])


def cols(*names: str) -> Expr:
    return Expr(lambda ctx: [Named(n, F.col(f"`{n}`")) for n in names])


def all_columns() -> Expr:
    return Expr(lambda ctx: [Named(n, F.col(f"`{n}`")) for n in ctx.df.columns])


def lit(value: Any) -> Expr:
    return Expr(lambda ctx: [Named("literal", F.lit(value))])


def length() -> Expr:
    """Number of rows."""
    return Expr(lambda ctx: [Named("len", ctx.aggregate(F.count(F.lit(1))), ctx.mode == "group")])


def if_else(condition: Expr, then: Any, otherwise: Any) -> Expr:
    out = operand(then).with_([condition, otherwise], lambda a, c, b: F.when(c, a).otherwise(b))
    return out


def as_struct(*parts: Any) -> Expr:
    def resolve(ctx: Context) -> list[Named]:
        inner = [n for p in parts for n in parse(p).resolve(ctx)]
        return [Named(inner[0].name, F.struct(*[n.column.alias(n.name) for n in inner]), any(n.agg for n in inner))]

    return Expr(resolve)
