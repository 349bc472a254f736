"""Text parsers that plans are built from: durations and strftime formats."""

from .duration import Duration, format_duration, parse_duration
from .strftime import java_pattern

__all__ = ["Duration", "format_duration", "java_pattern", "parse_duration"]
