"""Frames: a Spark DataFrame with expressions, and the order of its rows where that matters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import operators as O
from .errors import ColumnNotFound
from .functions.expr import Context, Expr, Named, gathered, parse
from .operators.dynamic import LOWER, UPPER

_POOL = ThreadPoolExecutor(max_workers=8)


class Frame:
    """Lazy: every method gives a new frame, and only collecting or writing runs a job."""

    def __init__(self, df: DataFrame, order: Sequence[str | Column] = ()) -> None:
        self.df = df
        self.order = tuple(F.col(f"`{o}`") if isinstance(o, str) else o for o in order)

    def _new(self, df: DataFrame) -> Frame:
        return Frame(df, self.order)

    def ordered_by(self, *order: str | Column) -> Frame:
        """Which order shift, diff, fills, row windows, first, last and implode follow."""
        return Frame(self.df, order)

    def _resolve(self, exprs: Sequence[Any], mode: str = "group") -> list[Named]:
        ctx = Context(self.df, self.order, mode)
        return [n for e in exprs for n in parse(e).resolve(ctx)]

    def _row_wise(self, exprs: Sequence[Any]) -> list[Named]:
        """Beside plain columns, aggregates are scalars of the whole frame."""
        found = self._resolve(exprs)
        return self._resolve(exprs, "scalar") if any(n.agg for n in found) else found

    # columns

    def select(self, *exprs: Any) -> Frame:
        found = self._resolve(exprs)
        if found and all(n.agg for n in found):
            return self._new(self.df.agg(*[n.column.alias(n.name) for n in found]))
        return self._new(self.df.select(*[n.column.alias(n.name) for n in self._row_wise(exprs)]))

    def with_columns(self, *exprs: Any) -> Frame:
        return self._new(self.df.withColumns({n.name: n.column for n in self._row_wise(exprs)}))

    def filter(self, condition: Expr) -> Frame:
        out = None
        for n in self._row_wise([condition]):
            out = n.column if out is None else out & n.column
        return self._new(self.df.filter(out))

    def _known(self, *names: str) -> None:
        missing = [n for n in names if n not in self.df.columns]
        if missing:
            raise ColumnNotFound(f"no such column: {', '.join(missing)}")

    def drop(self, *names: str) -> Frame:
        self._known(*names)
        return self._new(self.df.drop(*names))

    def rename(self, old: str, new: str) -> Frame:
        self._known(old)
        return self._new(self.df.withColumnRenamed(old, new))

    def drop_nulls(self, *subset: str) -> Frame:
        """Rows with a null; NaN is no null."""
        keep = F.lit(True)
        for c in subset or self.df.columns:
            keep &= F.col(f"`{c}`").isNotNull()
        return self._new(self.df.filter(keep))

    def fill_null(self, value: Any) -> Frame:
        return self._new(self.df.fillna(value))

    def unnest(self, *names: str) -> Frame:
        out: list[Column] = []
        for f in self.df.schema.fields:
            if f.name in names:
                out += [F.col(f"`{f.name}`.`{g}`").alias(g) for g in f.dataType.names]
            else:
                out.append(F.col(f"`{f.name}`"))
        return self._new(self.df.select(*out))

    def sample(self, n: int | None = None, fraction: float | None = None, with_replacement: bool = False, seed: int = 0) -> Frame:
        """Exactly n rows, or floor(height * fraction)."""
        height = self.height()
        n = int(height * fraction) if n is None else n
        if with_replacement:
            spark = self.df.sparkSession
            picks = spark.range(n).select(F.floor(F.rand(seed) * height).alias("__ordinal"))
            numbered = O.with_ordinal(self.df, [F.xxhash64(*self.df.columns)])
            return self._new(picks.join(numbered, "__ordinal").drop("__ordinal"))
        if n > height:
            raise ValueError(f"cannot take {n} of {height} rows")
        return self._new(self.df.orderBy(F.rand(seed)).limit(n))

    # rows

    def sort(self, *by: Any, descending: bool | Sequence[bool] = False) -> Frame:
        """Nulls first either way."""
        keys = self._row_wise(by)
        flags = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
        return self._new(self.df.orderBy(*[k.column.desc_nulls_first() if d else k.column.asc_nulls_first() for k, d in zip(keys, flags, strict=True)]))

    def limit(self, n: int) -> Frame:
        return self._new(self.df.limit(n))

    def head(self, n: int = 5) -> Frame:
        return self._new((self.df.orderBy(*self.order) if self.order else self.df).limit(n))

    def tail(self, n: int = 5) -> Frame:
        Context(self.df, self.order).rows()
        return self._new(self.df.orderBy(*[c.desc() for c in self.order]).limit(n).orderBy(*self.order))

    def top_k(self, k: int, *by: Any) -> Frame:
        return self.sort(*by, descending=True).limit(k)

    def distinct(self) -> Frame:
        return self._new(self.df.distinct())

    def explode(self, *names: str) -> Frame:
        return self._new(O.explode(self.df, *names))

    def pivot(self, index: Sequence[str], on: str, values: Sequence[str], agg: str = "first", columns: Sequence | None = None) -> Frame:
        return Frame(O.pivot(self.df, index, on, values, agg, columns, self.order))

    def unpivot(self, index: Sequence[str], on: Sequence[str] = (), variable: str = "variable", value: str = "value") -> Frame:
        return Frame(O.unpivot(self.df, index, on, variable, value))

    melt = unpivot

    # joins

    def join(self, other: Frame, on: Any = None, how: str = "inner", left_on: Any = None, right_on: Any = None) -> Frame:
        as_list = lambda x: [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]
        left, right = as_list(left_on if on is None else on), as_list(right_on if on is None else on)
        keys = [n.name for n in other._resolve(right)]
        return self._new(O.join(self.df, other.df, [n.column for n in self._resolve(left)], [n.column for n in other._resolve(right)], how, keys))

    def join_asof(self, other: Frame, left_on: str, right_on: str | None = None, by: Sequence[str] = (), by_right: Sequence[str] | None = None, strategy: str = "backward", tolerance: Any = None, sliced: bool | None = None) -> Frame:
        return self._new(O.join_asof(self.df, other.df, left_on, right_on or left_on, by, by if by_right is None else by_right, strategy, tolerance, sliced))

    # groups

    def group_by(self, *keys: Any) -> Grouped:
        return Grouped(self, self._row_wise(keys))

    def group_by_stable(self, *keys: Any) -> Grouped:
        """Groups come in the order in which the frame's order meets them first."""
        Context(self.df, self.order).rows()
        return Grouped(self, self._row_wise(keys), stable=True)

    def group_by_dynamic(self, time: str, every: Any, period: Any = None, offset: Any = "0s", by: Sequence[str] = (), label: str = "left", include_boundaries: bool = False, closed: str = "left", start_by: str = "window_bound") -> DynamicGrouped:
        return DynamicGrouped(self, time, every, period, offset, by, label, include_boundaries, closed, start_by)

    def describe(self, interpolation: str = "nearest") -> Frame:
        """Count, null count, mean, std, min, quartiles and max of each numeric column, from one aggregate."""
        names = [f.name for f in self.df.schema.fields if isinstance(f.dataType, T.NumericType)]
        if not names:
            raise ValueError("no numeric column")
        from .functions.expr import col

        stats = {"count": lambda c: c.count(), "null_count": lambda c: c.null_count(), "mean": lambda c: c.mean(), "std": lambda c: c.std(), "min": lambda c: c.min(), "25%": lambda c: c.quantile(0.25, interpolation), "50%": lambda c: c.median(), "75%": lambda c: c.quantile(0.75, interpolation), "max": lambda c: c.max()}
        one = self.select(*[f(col(n)).alias(f"{k}|{n}") for n in names for k, f in stats.items()]).df
        rows = F.array(*[F.struct(F.lit(k).alias("statistic"), *[F.col(f"`{k}|{n}`").cast("double").alias(n) for n in names]) for k in stats])
        return Frame(one.select(F.explode(rows).alias("r")).select("r.*"))

    # results

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def width(self) -> int:
        return len(self.df.columns)

    def height(self) -> int:
        return self.df.count()

    def row(self, i: int) -> dict[str, Any]:
        return self.head(i + 1).df.collect()[i].asDict(True)

    def item(self, i: int, name: str) -> Any:
        return self.row(i)[name]

    def collect(self) -> list:
        return self.df.collect()

    def collect_async(self) -> Future:
        return _POOL.submit(self.df.collect)

    def collect_streaming(self) -> Iterator[Any]:
        """Rows one partition after another, the next being made while one is read; the driver never holds them all."""
        return self.df.toLocalIterator(prefetchPartitions=True)

    def lazy(self) -> Frame:
        return self

    def column(self, which: str | int) -> Any:
        from .series import column

        return column(self, which)

    def get_columns(self) -> list:
        return [self.column(c) for c in self.df.columns]

    def print_schema(self) -> None:
        print(self.schema_text())

    def schema_text(self) -> str:
        return "\n".join(f"{f.name}: {f.dataType.simpleString()}" for f in self.df.schema.fields)

    def to_arrow(self):
        return self.df.toArrow()

    def to_dicts(self) -> list[dict[str, Any]]:
        return [r.asDict(True) for r in self.df.collect()]

    def to_html(self, limit: int = 10) -> str:
        return self.df.limit(limit).toPandas().to_html()

    _repr_html_ = to_html

    def show(self, n: int = 20) -> None:
        self.df.show(n)

    def explain(self, optimized: bool = True) -> str:
        plan = self.df._jdf.queryExecution()
        return (plan.optimizedPlan() if optimized else plan.analyzed()).toString()


class Grouped:
    def __init__(self, frame: Frame, keys: list[Named], stable: bool = False) -> None:
        self.frame, self.keys, self.stable = frame, keys, stable

    def agg(self, *exprs: Any) -> Frame:
        """One row a group; a bare column becomes the list of the group's values."""
        ctx = Context(self.frame.df, self.frame.order)
        found = self.frame._resolve(exprs)
        out = [n.column if n.agg else gathered(n.column, ctx) for n in found]
        grouped = self.frame.df.groupBy(*[k.column.alias(k.name) for k in self.keys])
        aggs = [c.alias(n.name) for c, n in zip(out, found)]
        if not self.stable:
            return Frame(grouped.agg(*aggs))
        met = F.min(F.struct(*self.frame.order)).alias("__met")
        return Frame(grouped.agg(*aggs, met).orderBy("__met").drop("__met"))


class DynamicGrouped:
    def __init__(self, frame: Frame, time: str, every: Any, period: Any, offset: Any, by: Sequence[str], label: str, include_boundaries: bool, closed: str, start_by: str) -> None:
        self.frame, self.time, self.by, self.label, self.bounds = frame, time, list(by), label, include_boundaries
        self.windows = O.dynamic_windows(frame.df, time, every, period, offset, by, closed, start_by)

    def agg(self, *exprs: Any) -> Frame:
        """A row for each group and window that holds rows: keys, bounds if asked for, the label under the time's name."""
        inner = Frame(self.windows, self.frame.order)
        found = inner._resolve(exprs)
        ctx = Context(self.windows, self.frame.order)
        label = {"left": F.col(LOWER), "right": F.col(UPPER), "data_point": F.col("__label")}[self.label]
        aggs = [(n.column if n.agg else gathered(n.column, ctx)).alias(n.name) for n in found]
        grouped = self.windows.groupBy(*[F.col(f"`{c}`") for c in self.by], LOWER, UPPER).agg(F.min(F.col(f"`{self.time}`")).alias("__label"), *aggs)
        bounds = [LOWER, UPPER] if self.bounds else []
        return Frame(grouped.select(*self.by, *bounds, label.alias(self.time), *[f"`{n.name}`" for n in found]))


def concat(frames: Sequence[Frame], how: str = "vertical") -> Frame:
    dfs = [f.df for f in frames]
    if how == "vertical":
        return Frame(O.concat_vertical(dfs))
    if how == "diagonal":
        return Frame(O.concat_diagonal(dfs))
    if how == "horizontal":
        return Frame(O.concat_horizontal(dfs, [f.order for f in frames]))
    raise ValueError(f"unknown way {how!r}")
