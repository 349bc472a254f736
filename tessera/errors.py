"""What the library raises of its own accord; each is also the built-in error that callers may expect."""

from __future__ import annotations


class TesseraError(Exception):
    """Every error that isn't Spark's."""


class ColumnNotFound(TesseraError, ValueError):
    """A name that the frame doesn't have."""


class LengthMismatch(TesseraError, ValueError):
    """Series of different lengths, none of which is 1."""
