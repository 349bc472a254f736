"""Column types: constructors, what they are made of, and their Arrow form."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import types as T

# The name of each plain kind and its Spark type. Spark has no unsigned numbers and no dictionary type.
PLAIN = {
    "bool": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType(),
    "str": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(), "null": T.NullType(), "categorical": T.StringType(),
}


def plain(name: str) -> T.DataType:
    if name not in PLAIN:
        raise ValueError(f"no plain type {name!r}: one of {', '.join(PLAIN)}")
    return PLAIN[name]


def decimal(precision: int, scale: int = 0) -> T.DecimalType:
    return T.DecimalType(precision, scale)


def datetime(zone: str | None = None) -> T.DataType:
    """Microseconds; with a zone an instant, which the session's zone shows, else a wall clock."""
    return T.TimestampType() if zone else T.TimestampNTZType()


def duration() -> T.DayTimeIntervalType:
    return T.DayTimeIntervalType()


def list_of(inner: T.DataType) -> T.ArrayType:
    return T.ArrayType(inner)


def struct_of(fields: Mapping[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


schema = struct_of


def kind(dtype: T.DataType) -> str:
    for name, t in PLAIN.items():
        if type(dtype) is type(t):
            return name
    made = {T.DecimalType: "decimal", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DayTimeIntervalType: "duration", T.ArrayType: "list", T.StructType: "struct", T.MapType: "map"}
    return made.get(type(dtype), dtype.typeName())


def text(dtype: T.DataType) -> str:
    """With all that is nested in it: `struct<a:array<int>>`."""
    return dtype.simpleString()


def time_unit(dtype: T.DataType) -> str | None:
    return "us" if kind(dtype) in ("datetime", "duration") else None


def time_zone(dtype: T.DataType) -> str | None:
    """Instants are shown in the session's zone; wall clocks have none."""
    if not isinstance(dtype, T.TimestampType):
        return None
    from .session import active

    return active().conf.get("spark.sql.session.timeZone")


def decimal_info(dtype: T.DataType) -> tuple[int, int] | None:
    return (dtype.precision, dtype.scale) if isinstance(dtype, T.DecimalType) else None


def inner(dtype: T.DataType) -> T.DataType | None:
    return dtype.elementType if isinstance(dtype, T.ArrayType) else None


def fields(dtype: T.DataType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in dtype.fields} if isinstance(dtype, T.StructType) else {}


def to_arrow(dtype: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dtype)
