"""Operators on Spark DataFrames that Spark has no single call for."""

from .asof import join_asof
from .dynamic import WINDOW_STARTS, dynamic_windows
from .joins import join
from .reshape import concat_diagonal, concat_horizontal, concat_vertical, explode, pivot, unpivot, with_ordinal

__all__ = ["WINDOW_STARTS", "concat_diagonal", "concat_horizontal", "concat_vertical", "dynamic_windows", "explode", "join", "join_asof", "pivot", "unpivot", "with_ordinal"]
