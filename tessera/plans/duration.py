"""Durations: `1h30m`, `2d`, `-5s`, `1mo`."""

from __future__ import annotations

import datetime as dt
import re
from typing import NamedTuple

# Microseconds of each unit, and months of each calendar unit.
MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
MONTHS = {"mo": 1, "q": 3, "y": 12}
_PART = re.compile(r"(\d+)(ns|us|ms|mo|[smhdwqy])")


class Duration(NamedTuple):
    months: int
    micros: int


def parse_duration(value: str | dt.timedelta | int) -> Duration:
    """Text, a timedelta, or microseconds. Nanoseconds count in whole thousands, since Spark keeps microseconds."""
    if isinstance(value, int):
        return Duration(0, value)
    if isinstance(value, dt.timedelta):
        return Duration(0, value // dt.timedelta(microseconds=1))
    text, sign = value.strip(), 1
    if text[:1] in ("+", "-"):
        sign, text = (-1 if text[0] == "-" else 1), text[1:]
    parts = _PART.findall(text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {value!r}")
    months = sum(int(n) * MONTHS[u] for n, u in parts if u in MONTHS)
    nanos = sum(int(n) * (1 if u == "ns" else 1000 * MICROS[u]) for n, u in parts if u not in MONTHS)
    if nanos % 1000:
        raise ValueError(f"{value!r} is finer than a microsecond")
    return Duration(sign * months, sign * nanos // 1000)


def fixed_micros(value: str | dt.timedelta | int) -> int:
    """Microseconds of a duration without calendar units."""
    d = parse_duration(value)
    if d.months:
        raise ValueError(f"{value!r} has no fixed length")
    return d.micros


def format_duration(value: dt.timedelta) -> str:
    """Largest unit first; `0s` for none; a minus before a negative one."""
    left = abs(value // dt.timedelta(microseconds=1))
    out = ""
    for unit in ("d", "h", "m", "s", "ms", "us"):
        n, left = divmod(left, MICROS[unit])
        out += f"{n}{unit}" if n else ""
    return ("-" if value < dt.timedelta() else "") + (out or "0s")
