"""Equi-joins with one set of key columns in the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOW = {"inner": "inner", "left": "left", "full": "full", "outer": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti", "right": "right"}


def _apart(right: DataFrame, taken: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """The right side under names that the left side can't have, and what each column is called in the result."""
    inner = {c: f"__right_{k}" for k, c in enumerate(right.columns)}
    names = {c: c + "_right" if c in taken else c for c in right.columns}
    return right.select(*[F.col(f"`{c}`").alias(inner[c]) for c in right.columns]), {inner[c]: names[c] for c in right.columns}


def join(left: DataFrame, right: DataFrame, left_on: Sequence[Column], right_on: Sequence[Column], how: str = "inner", right_keys: Sequence[str] = ()) -> DataFrame:
    """Null keys match nothing. Right key columns are dropped but for full and cross joins; other right columns whose
    names the left side has get the suffix `_right`. Catalyst picks the physical join."""
    kind = HOW[how]
    left_in = left.select("*", *[k.alias(f"__lk_{i}") for i, k in enumerate(left_on)])
    right_in = right.select("*", *[k.alias(f"__rk_{i}") for i, k in enumerate(right_on)])
    keys = [F.col(f"__lk_{i}") == F.col(f"__rk_{i}") for i in range(len(left_on))]
    lefts = [F.col(f"`{c}`") for c in left.columns]
    if kind in ("left_semi", "left_anti"):
        return left_in.join(right_in.select(*[f"__rk_{i}" for i in range(len(right_on))]), keys, kind).select(*lefts)
    moved, names = _apart(right, left.columns)
    right_in = right_in.select(*[F.col(f"`{c}`").alias(f"__right_{k}") for k, c in enumerate(right.columns)], *[f"__rk_{i}" for i in range(len(right_on))])
    out = left_in.crossJoin(right_in) if kind == "cross" else left_in.join(right_in, keys, kind)
    dropped = set() if kind in ("full", "cross", "right") else {f"__right_{k}" for k, c in enumerate(right.columns) if c in right_keys}
    return out.select(*lefts, *[F.col(i).alias(n) for i, n in names.items() if i not in dropped])
