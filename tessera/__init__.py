"""A PySpark-native analytics engine: expressions, frames, time windows, sources and sinks on Spark SQL."""

from .errors import ColumnNotFound, LengthMismatch, TesseraError
from .frame import Frame, concat
from .functions import *  # noqa: F403
from .series import Series, from_series
from .session import session
from .sql import SqlContext

__all__ = ["ColumnNotFound", "Frame", "LengthMismatch", "Series", "SqlContext", "TesseraError", "concat", "from_series", "session"]
