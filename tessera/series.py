"""Series: one named column of a frame, lazy as the frame is.

Series of one frame combine in a projection. Of different frames, one of length 1 goes with every value of the other (as
a scalar subquery); equally long ones are joined by row number in each one's order, without a sort in one task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import operators as O
from .errors import LengthMismatch
from .frame import Frame
from .functions import map_values
from .functions.expr import Expr, Named, col, lit
from .session import active

PLACE = "__place"


class Series:
    def __init__(self, frame: Frame, expr: Expr, name: str) -> None:
        self.frame, self.expr, self.name = frame, expr, name
        self._length: int | None = None

    @classmethod
    def of(cls, name: str, values: Sequence[Any], dtype: str | T.DataType | None = None, valid: Sequence[bool] | None = None) -> Series:
        """Of values in their order; where `valid` is false the value is null. Without a type, Arrow infers it."""
        values = list(values) if valid is None else [v if ok else None for v, ok in zip(values, valid, strict=True)]
        out = cls.from_arrow(name, pa.array(values))
        return out if dtype is None else out.cast(dtype)

    @classmethod
    def from_arrow(cls, name: str, array: pa.Array | pa.ChunkedArray) -> Series:
        if pa.types.is_null(array.type):
            array = array.cast(pa.string())
        table = pa.table({PLACE: pa.array(range(len(array)), pa.int64()), name: array})
        out = cls(Frame(active().createDataFrame(table), [PLACE]), col(name), name)
        out._length = len(array)
        return out

    def _new(self, expr: Expr, name: str | None = None) -> Series:
        out = Series(self.frame, expr, name or self.name)
        out._length = self._length
        return out

    # what it is

    def rename(self, name: str) -> Series:
        return self._new(self.expr, name)

    @property
    def dtype(self) -> T.DataType:
        return self.to_frame().schema[0].dataType

    def __len__(self) -> int:
        if self._length is None:
            self._length = self.to_frame().height()
        return self._length

    # as something else

    def to_frame(self) -> Frame:
        return Frame(self._sorted().select(self.expr.alias(self.name)).df)

    def _sorted(self) -> Frame:
        return Frame(self.frame.df.orderBy(*self.frame.order), self.frame.order) if self.frame.order else self.frame

    def to_arrow(self) -> pa.ChunkedArray:
        return self.to_frame().to_arrow().column(0)

    def to_list(self) -> list[Any]:
        return [r[0] for r in self.to_frame().collect()]

    def __iter__(self) -> Iterator[Any]:
        return (r[0] for r in self.to_frame().df.toLocalIterator())

    def _numbered(self, name: str):
        """(__ordinal, name) in the frame's order."""
        value = self.frame.with_columns(self.expr.alias("__value"))
        self._needs_order()
        return O.with_ordinal(value.df, self.frame.order).select("__ordinal", F.col("__value").alias(name))

    def _needs_order(self) -> None:
        if not self.frame.order:
            raise ValueError("row order matters here: give the frame one with ordered_by()")

    def slice(self, offset: int, length: int | None = None) -> Series:
        """`length` values from `offset` on; an offset below 0 counts from the end. Past the end there is nothing."""
        start = offset if offset >= 0 else max(0, len(self) + offset)
        numbered = self._numbered(self.name).filter(F.col("__ordinal") >= start)
        if length is not None:
            numbered = numbered.filter(F.col("__ordinal") < start + length)
        return Series(Frame(numbered, ["__ordinal"]), col(self.name), self.name)

    # single values

    def get(self, i: int) -> Any:
        """The value at a place; below 0 from the end."""
        place = i if i >= 0 else len(self) + i
        found = self.to_frame().df.offset(place).limit(1).collect() if place >= 0 else []
        if not found:
            raise IndexError(f"no place {i}")
        return found[0][0]

    def _typed(self, i: int, kinds: type | tuple[type, ...]) -> Any:
        """The value if it is of the kind asked for, else None."""
        value = self.get(i)
        fits = isinstance(value, kinds) and not (isinstance(value, bool) and kinds is not bool) and not (isinstance(value, dt.datetime) and kinds is dt.date)
        return value if fits else None

    def get_int(self, i: int) -> int | None:
        return self._typed(i, int)

    def get_float(self, i: int) -> float | None:
        return self._typed(i, float)

    def get_bool(self, i: int) -> bool | None:
        return self._typed(i, bool)

    def get_str(self, i: int) -> str | None:
        return self._typed(i, str)

    def get_decimal(self, i: int) -> Decimal | None:
        return self._typed(i, Decimal)

    def get_date(self, i: int) -> dt.date | None:
        return self._typed(i, dt.date)

    def get_time(self, i: int) -> dt.time | None:
        return self._typed(i, dt.time)

    def get_datetime(self, i: int) -> dt.datetime | None:
        return self._typed(i, dt.datetime)

    def get_duration(self, i: int) -> dt.timedelta | None:
        return self._typed(i, dt.timedelta)

    def is_null_at(self, i: int) -> bool:
        return self.get(i) is None

    def null_count(self) -> int:
        return self.frame.select(self.expr.null_count().alias("n")).collect()[0][0]

    # value by value

    def cast(self, kind: str | T.DataType, strict: bool = False) -> Series:
        return self._new(self.expr.cast(kind, strict))

    def is_null(self) -> Series:
        return self._new(self.expr.is_null())

    def is_not_null(self) -> Series:
        return self._new(self.expr.is_not_null())

    def is_nan(self) -> Series:
        return self._new(self.expr.is_nan())

    def is_not_nan(self) -> Series:
        return self._new(self.expr.is_not_nan())

    def is_finite(self) -> Series:
        return self._new(self.expr.is_finite())

    def is_infinite(self) -> Series:
        return self._new(self.expr.is_infinite())

    def map(self, f: Callable[[Any], Any], returns: str | T.DataType | None = None, skip_nulls: bool = True) -> Series:
        return self._new(map_values(self.expr, f, returns, skip_nulls))

    # two series

    def _scalar(self) -> Expr:
        value = self.to_frame().df
        return Expr(lambda ctx: [Named(self.name, value.scalar())])

    def _pair(self, other: Any, f: Callable[[Expr, Expr], Expr]) -> Series:
        if not isinstance(other, Series):
            return self._new(f(self.expr, lit(other)))
        if other.frame.df is self.frame.df:
            return self._new(f(self.expr, other.expr))
        if len(other) == 1:
            return self._new(f(self.expr, other._scalar()))
        if len(self) == 1:
            return other._new(f(self._scalar(), other.expr), self.name)
        if len(self) != len(other):
            raise LengthMismatch(f"{self.name} has {len(self)} values, {other.name} has {len(other)}")
        both = self._numbered("__a").join(other._numbered("__b"), "__ordinal")
        out = Series(Frame(both, ["__ordinal"]), f(col("__a"), col("__b")), self.name)
        out._length = len(self)
        return out

    def __add__(self, o):
        return self._pair(o, lambda a, b: a + b)

    def __sub__(self, o):
        return self._pair(o, lambda a, b: a - b)

    def __mul__(self, o):
        return self._pair(o, lambda a, b: a * b)

    def __truediv__(self, o):
        return self._pair(o, lambda a, b: a / b)

    def __eq__(self, o):  # type: ignore[override]
        return self._pair(o, lambda a, b: a == b)

    def __ne__(self, o):  # type: ignore[override]
        return self._pair(o, lambda a, b: a != b)

    __hash__ = None  # type: ignore[assignment]

    def __gt__(self, o):
        return self._pair(o, lambda a, b: a > b)

    def __ge__(self, o):
        return self._pair(o, lambda a, b: a >= b)

    def __lt__(self, o):
        return self._pair(o, lambda a, b: a < b)

    def __le__(self, o):
        return self._pair(o, lambda a, b: a <= b)

    # series of length 1

    def _whole(self, e: Expr) -> Series:
        out = Series(self.frame.select(e.alias(self.name)).ordered_by(), col(self.name), self.name)
        out._length = 1
        return out

    def sum(self) -> Series:
        return self._whole(self.expr.sum())

    def mean(self) -> Series:
        return self._whole(self.expr.mean())

    def min(self) -> Series:
        return self._whole(self.expr.min())

    def max(self) -> Series:
        return self._whole(self.expr.max())


def column(frame: Frame, which: str | int) -> Series:
    """A frame's column by name or place, in the order that the frame was given."""
    if isinstance(which, int):
        which = frame.columns[which]
    frame._known(which)
    return Series(frame, col(which), which)


def from_series(*series: Series) -> Frame:
    """A frame of equally long series; those of length 1 go with every row."""
    if not series:
        raise ValueError("no series")
    longest = max(map(len, series))
    if any(len(s) not in (1, longest) for s in series):
        raise LengthMismatch(", ".join(f"{s.name}: {len(s)}" for s in series))
    lead = next(s for s in series if len(s) == longest)
    if all(s.frame.df is lead.frame.df or len(s) == 1 for s in series):
        exprs = [(s.expr if s.frame.df is lead.frame.df else s._scalar()).alias(s.name) for s in series]
        return lead._sorted().select(*exprs)
    out = None
    for s in series:
        if len(s) == longest:
            numbered = s._numbered(s.name)
            out = numbered if out is None else out.join(numbered, "__ordinal")
    joined = Frame(out, ["__ordinal"])
    exprs = [(col(s.name) if len(s) == longest else s._scalar()).alias(s.name) for s in series]
    return Frame(joined.df.orderBy("__ordinal")).select(*exprs)
