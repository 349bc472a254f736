"""Expressions, selectors and user-defined functions."""

from .expr import Expr, all_columns, as_struct, col, cols, if_else, length, lit
from .selectors import Selector, by_dtype, contains, ends_with, exclude, matches, numeric, starts_with, strings, temporal
from .udf import map_batches, map_values

__all__ = ["Expr", "Selector", "all_columns", "as_struct", "by_dtype", "col", "cols", "contains", "ends_with", "exclude", "if_else", "length", "lit", "map_batches", "map_values", "matches", "numeric", "starts_with", "strings", "temporal"]
