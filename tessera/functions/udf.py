"""User-defined functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import Context, Expr


def map_batches(e: Expr, f: Callable[[pd.Series], pd.Series], returns: str | T.DataType | None = None) -> Expr:
    """f gets a batch of the column as a Series; returns: its type, by default the column's own."""
    return e.map_in(lambda c, ctx: F.pandas_udf(f, returns or ctx.type_of(c))(c))


def map_values(e: Expr, f: Callable[[Any], Any], returns: str | T.DataType | None = None, skip_nulls: bool = True) -> Expr:
    """f gets each value; nulls give null without it, or reach it as None where skip_nulls is off. Errors surface."""

    def one(value: Any) -> Any:
        return None if value is None and skip_nulls else f(value)

    def build(c, ctx: Context):
        return F.udf(one, returns or ctx.type_of(c), useArrow=True)(c)

    return e.map_in(build)
