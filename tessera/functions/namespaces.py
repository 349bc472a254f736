"""Functions of strings, times, lists, structs and names."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.duration import MICROS, MONTHS, fixed_micros, parse_duration
from ..plans.strftime import java_pattern
from .expr import Context, Expr, Named, operand

SPACES = " \t\n\r\x0b\x0c\x85\xa0  "


def java_regex(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


class Strings:
    def __init__(self, e: Expr) -> None:
        self.e = e

    def to_upper(self) -> Expr:
        return self.e.map(F.upper)

    def to_lower(self) -> Expr:
        return self.e.map(F.lower)

    def len(self) -> Expr:
        """In bytes of UTF-8."""
        return self.e.map(lambda c: F.octet_length(c).cast("long"))

    def len_chars(self) -> Expr:
        return self.e.map(lambda c: F.char_length(c).cast("long"))

    def slice(self, offset: int, length: int | None = None) -> Expr:
        """From a place counted from the start, or from the end if negative; one before the start loses characters."""

        def cut(c: Column) -> Column:
            size = F.char_length(c)
            start = F.lit(offset) if offset >= 0 else size + offset
            stop = F.lit(2**31 - 1) if length is None else start + length
            return F.substr(c, F.greatest(start, F.lit(0)) + 1, F.greatest(F.least(stop, size) - F.greatest(start, F.lit(0)), F.lit(0)))

        return self.e.map(cut)

    def replace_all(self, pattern: str, value: str, regex: bool = False) -> Expr:
        """In a regex's value, $1, ${1} and ${name} are groups."""
        filled = re.sub(r"\$\{(\d+)\}", r"$\1", value)
        return self.e.map(lambda c: F.regexp_replace(c, java_regex(pattern), filled) if regex else F.replace(c, F.lit(pattern), F.lit(value)))

    def extract(self, pattern: str, group: int = 1) -> Expr:
        """Null where nothing matches."""
        return self.e.map(lambda c: F.when(c.rlike(java_regex(pattern)), F.regexp_extract(c, java_regex(pattern), group)))

    def contains(self, pattern: str) -> Expr:
        return self.e.map(lambda c: c.rlike(java_regex(pattern)))

    def split(self, by: str) -> Expr:
        return self.e.map(lambda c: F.split(c, re.sub(r"([^\w\s])", r"\\\1", by), -1))

    def strip_chars(self, chars: str | None = None) -> Expr:
        return self.e.map(lambda c: F.btrim(c, F.lit(SPACES if chars is None else chars)))

    def strip_chars_start(self, chars: str | None = None) -> Expr:
        return self.e.map(lambda c: F.ltrim(c, F.lit(SPACES if chars is None else chars)))

    def strip_chars_end(self, chars: str | None = None) -> Expr:
        return self.e.map(lambda c: F.rtrim(c, F.lit(SPACES if chars is None else chars)))

    def strip_prefix(self, prefix: str) -> Expr:
        return self.e.map(lambda c: F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c))

    def strip_suffix(self, suffix: str) -> Expr:
        return self.e.map(lambda c: F.when(c.endswith(suffix), F.substr(c, F.lit(1), F.char_length(c) - len(suffix))).otherwise(c))

    def starts_with(self, prefix: str) -> Expr:
        return self.e.map(lambda c: c.startswith(prefix))

    def ends_with(self, suffix: str) -> Expr:
        return self.e.map(lambda c: c.endswith(suffix))

    def to_date(self, fmt: str = "%Y-%m-%d") -> Expr:
        """Null where the text doesn't have the format."""
        return self.e.map(lambda c: F.try_to_timestamp(c, F.lit(java_pattern(fmt))).cast("date"))

    def to_datetime(self, fmt: str) -> Expr:
        return self.e.map(lambda c: F.try_to_timestamp(c, F.lit(java_pattern(fmt))).cast("timestamp_ntz"))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def _moved(c: Column, by: Column) -> Column:
    text = F.trim(by)
    sign = F.when(text.startswith("-"), F.lit(-1)).otherwise(F.lit(1))

    def total(units: dict[str, int]) -> Column:
        out = F.lit(0).cast("long")
        for unit, size in units.items():
            # "5m" isn't the start of "5mo" or "5ms"
            found = F.regexp_extract_all(text, F.lit(rf"(\d+){unit}(?![a-z])"), F.lit(1))
            out += F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) * size
        return out * sign

    # nanoseconds don't reach here: Spark keeps microseconds
    good = text.rlike(r"^[+-]?(\d+(us|ms|mo|[smhdwqy]))+$")
    months = F.when(by.isNull() | good, total(MONTHS)).otherwise(F.raise_error(F.concat(F.lit("not a duration: "), by)).cast("long"))
    out = c.cast("timestamp_ntz") + F.make_interval(months=months.cast("int"))
    return from_micros(micros(out) + total(MICROS))


class Temporal:
    def __init__(self, e: Expr) -> None:
        self.e = e

    def _part(self, f) -> Expr:
        return self.e.map(f)

    def year(self) -> Expr:
        return self._part(F.year)

    def month(self) -> Expr:
        return self._part(F.month)

    def day(self) -> Expr:
        return self._part(F.dayofmonth)

    def ordinal_day(self) -> Expr:
        return self._part(F.dayofyear)

    def weekday(self) -> Expr:
        """Monday is 1, Sunday 7."""
        return self._part(lambda c: F.weekday(c) + 1)

    def hour(self) -> Expr:
        return self._part(F.hour)

    def minute(self) -> Expr:
        return self._part(F.minute)

    def second(self) -> Expr:
        return self._part(F.second)

    def millisecond(self) -> Expr:
        return self._part(lambda c: F.floor(F.pmod(micros(c), F.lit(1_000_000)) / 1000).cast("int"))

    def microsecond(self) -> Expr:
        return self._part(lambda c: F.pmod(micros(c), F.lit(1_000_000)).cast("int"))

    def nanosecond(self) -> Expr:
        return self._part(lambda c: F.pmod(micros(c), F.lit(1_000_000)) * 1000)

    def date(self) -> Expr:
        return self._part(F.to_date)

    def time(self) -> Expr:
        """Time of day; needs spark.sql.timeType.enabled."""
        return self._part(lambda c: F.make_time(F.hour(c), F.minute(c), F.second(c) + F.pmod(micros(c), F.lit(1_000_000)) / F.lit(1_000_000).cast("decimal(16,6)")))

    def to_string(self, fmt: str = "%Y-%m-%dT%H:%M:%S%.f") -> Expr:
        return self._part(lambda c: F.date_format(c, java_pattern(fmt)))

    def truncate(self, every: str) -> Expr:
        d = parse_duration(every)
        if d.months and d.micros:
            raise ValueError(f"{every!r} mixes months with shorter units")

        def cut(c: Column, ctx: Context) -> Column:
            if d.months:
                months = (F.year(c) * 12 + F.month(c) - 1).cast("int")
                start = months - F.pmod(months, F.lit(d.months))
                return F.make_timestamp_ntz(F.floor(start / 12).cast("int"), F.pmod(start, F.lit(12)) + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
            # weeks start on Monday; 1970-01-05 was one
            base = 4 * 86_400_000_000 if d.micros % (7 * 86_400_000_000) == 0 else 0
            return from_micros(micros(c) - F.pmod(micros(c) - base, F.lit(d.micros)))

        return self.e.map_in(cut)

    def round(self, every: str) -> Expr:
        n = fixed_micros(every)
        return self.e.map(lambda c: from_micros((t := micros(c) + n // 2) - F.pmod(t, F.lit(n))))

    def offset_by(self, by: str | Expr) -> Expr:
        """By a duration, or by each row's own: an expression of duration texts; null for a null one."""
        if isinstance(by, Expr):
            return self.e.with_([by], _moved)
        d = parse_duration(by)

        def move(c: Column, ctx: Context) -> Column:
            is_date = isinstance(ctx.type_of(c), T.DateType)
            out = c.cast("timestamp_ntz") + F.make_interval(months=F.lit(d.months)) if d.months else c.cast("timestamp_ntz")
            out = from_micros(micros(out) + d.micros) if d.micros else out
            return out.cast("date") if is_date and d.micros % 86_400_000_000 == 0 else out

        return self.e.map_in(move)

    def timestamp(self, unit: str = "us") -> Expr:
        """Since 1970: ns, us or ms."""
        return self._part({"us": micros, "ms": lambda c: F.floor(micros(c) / 1000), "ns": lambda c: micros(c) * 1000}[unit])

    def convert_time_zone(self, zone: str, source: str = "UTC") -> Expr:
        """The wall clock in another zone of the same instant."""
        return self._part(lambda c: F.convert_timezone(F.lit(source), F.lit(zone), c.cast("timestamp_ntz")))

    def replace_time_zone(self, zone: str | None, ambiguous: str = "raise", non_existent: str = "raise") -> Expr:
        """The instant (in UTC) at which the zone's wall clock shows this time; null takes the zone away.

        ambiguous: raise, earliest, latest or null; non_existent: raise or null.
        """
        if zone is None:
            return self._part(lambda c: c.cast("timestamp_ntz"))

        def utc(c: Column) -> Column:
            wall = c.cast("timestamp_ntz")
            first = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
            back = lambda x: F.convert_timezone(F.lit("UTC"), F.lit(zone), x)
            hour = F.expr("INTERVAL 1 HOUR")
            later, earlier = F.when(back(first + hour) == wall, first + hour), F.when(back(first - hour) == wall, first - hour)
            twice = later.isNotNull() | earlier.isNotNull()
            fail = lambda text: F.raise_error(F.concat(F.lit(text), wall.cast("string"))).cast("timestamp_ntz")
            none = F.lit(None).cast("timestamp_ntz")
            pick = {"raise": fail("ambiguous time: "), "null": none, "earliest": F.coalesce(earlier, first), "latest": F.coalesce(later, first)}[ambiguous]
            return F.when(wall.isNull(), none).when(back(first) != wall, fail("no such time: ") if non_existent == "raise" else none).when(twice, pick).otherwise(first)

        return self._part(utc)


class Lists:
    def __init__(self, e: Expr) -> None:
        self.e = e

    def first(self) -> Expr:
        return self.get(0)

    def get(self, i: int) -> Expr:
        """From the end if negative; null out of bounds."""
        return self.e.map(lambda c: F.try_element_at(c, F.lit(i + 1 if i >= 0 else i)))

    def len(self) -> Expr:
        return self.e.map(lambda c: F.array_size(c).cast("long"))

    def sum(self) -> Expr:
        return self.e.map_in(lambda c, ctx: F.aggregate(c, F.lit(0).cast(_sum_type(c, ctx)), lambda a, x: a + F.coalesce(x.cast(_sum_type(c, ctx)), F.lit(0).cast(_sum_type(c, ctx)))))

    def mean(self) -> Expr:
        def mean(c: Column) -> Column:
            solid = F.filter(c, lambda x: x.isNotNull())
            return F.try_divide(F.aggregate(solid, F.lit(0.0), lambda a, x: a + x.cast("double")), F.size(solid))

        return self.e.map(mean)

    def min(self) -> Expr:
        return self.e.map(F.array_min)

    def max(self) -> Expr:
        return self.e.map(F.array_max)

    def sort(self, descending: bool = False) -> Expr:
        """Nulls come first either way."""

        def ordered(c: Column) -> Column:
            if not descending:
                return F.sort_array(c)
            return F.concat(F.filter(c, lambda x: x.isNull()), F.sort_array(F.filter(c, lambda x: x.isNotNull()), asc=False))

        return self.e.map(ordered)

    def join(self, by: str) -> Expr:
        return self.e.map(lambda c: F.array_join(c.cast("array<string>"), by))

    def contains(self, item: Any) -> Expr:
        return self.e.with_([item], lambda c, v: F.exists(c, lambda x: x.eqNullSafe(v)))


def _sum_type(c: Column, ctx: Context) -> str:
    return "double" if isinstance(ctx.type_of(c).elementType, T.FractionalType) else "long"


class Structs:
    def __init__(self, e: Expr) -> None:
        self.e = e

    def field(self, which: str | int) -> Expr:
        def resolve(ctx: Context) -> list[Named]:
            out = []
            for n in self.e.resolve(ctx):
                name = which if isinstance(which, str) else ctx.type_of(n.column).names[which]
                out.append(Named(name, n.column.getField(name), n.agg))
            return out

        return Expr(resolve)

    def rename_fields(self, names: list[str]) -> Expr:
        def renamed(c: Column, ctx: Context) -> Column:
            fields = ctx.type_of(c).fields
            return c.cast(T.StructType([T.StructField(new, f.dataType, f.nullable) for new, f in zip(names, fields)]))

        return self.e.map_in(renamed)

    def json_encode(self) -> Expr:
        return self.e.map(lambda c: F.to_json(c, {"ignoreNullFields": "false"}))


class Names:
    def __init__(self, e: Expr) -> None:
        self.e = e

    def _named(self, f) -> Expr:
        return Expr(lambda ctx: [Named(f(n.name), n.column, n.agg, n.rows) for n in self.e.resolve(ctx)])

    def prefix(self, text: str) -> Expr:
        return self._named(lambda name: text + name)

    def suffix(self, text: str) -> Expr:
        return self._named(lambda name: name + text)
