"""CSV, JSON and Parquet."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import Future

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import _POOL, Frame
from ..session import active


def read_csv(path: str, schema: Mapping[str, str | T.DataType] | None = None, header: bool = True, separator: str = ",", skip_rows: int = 0, parse_dates: bool = True) -> Frame:
    """Types are inferred but for the columns named in schema. Blank lines are rows of nulls, as empty fields are null.

    skip_rows counts lines at the start of each file. Files of one column, whose blank lines Spark's own reader would
    leave out, and skipped lines are read as lines; else Spark's reader splits files among tasks. All files must have
    one header.
    """
    spark = active()
    if not skip_rows:
        plain = spark.read.csv(path, header=header, sep=separator, inferSchema=True, ignoreLeadingWhiteSpace=False)
        if len(plain.columns) > 1:
            return Frame(_overridden(plain, schema or {}, parse_dates))
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    # one row a file: its first line after those skipped
    place = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    heads = lines.withColumn("place", place).filter(F.col("place") <= skip_rows + 1).filter(F.col("place") == skip_rows + 1)
    tops = [r["value"] for r in heads.select("value").distinct().limit(2).collect()] if header else [r["value"] for r in heads.orderBy("file").limit(1).collect()]
    if not tops:
        raise ValueError("there are no lines after those skipped")
    if len(tops) > 1:
        raise ValueError(f"files have different headers: {tops}")
    ddl = ", ".join(f"c{k} string" for k in range(tops[0].count(separator) + 1))
    names = list(spark.createDataFrame(tops, "string").select(F.from_csv("value", F.lit(ddl), {"sep": separator}).alias("x")).select("x.*").first())
    names = [str(n) for n in names if n is not None] if header else [f"column_{k + 1}" for k in range(len(names))]
    # as many rows as the file listing, which the driver holds anyway; lines keep their order so
    body = lines.join(F.broadcast(heads.select("file", F.col("at").alias("head"))), "file")
    body = body.filter(F.col("at") > F.col("head") if header else F.col("at") >= F.col("head"))
    raw = body.select(F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in names)), {"sep": separator}).alias("x")).select("x.*")
    kinds = _inferred(raw)
    typed = raw.select(*[F.col(f"`{n}`").try_cast(kinds[n]).alias(n) for n in names])
    return Frame(_overridden(typed, schema or {}, parse_dates, raw))


# Types in the order in which they are tried, and how their texts look.
LOOKS = {"int": r"^\s*[+-]?\d+\s*$", "bigint": r"^\s*[+-]?\d+\s*$", "double": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", "date": r"^\d{4}-\d{2}-\d{2}$", "timestamp": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}", "boolean": r"^(?i:true|false)$"}


def _inferred(raw: DataFrame) -> dict[str, str]:
    """The first type that every value of a column has; string where none does, or there is no value."""
    value = lambda n: F.col(f"`{n}`")
    every = [F.every(value(n).isNull() | (value(n).rlike(look) & value(n).try_cast(kind).isNotNull())).alias(f"{k}-{kind}") for k, n in enumerate(raw.columns) for kind, look in LOOKS.items()]
    got = raw.agg(*every, *[F.count(value(n)).alias(f"{k}-n") for k, n in enumerate(raw.columns)]).first()
    return {n: next((kind for kind in LOOKS if got[f"{k}-n"] and got[f"{k}-{kind}"]), "string") for k, n in enumerate(raw.columns)}


def _overridden(df, schema, parse_dates, raw=None):
    source = raw if raw is not None else df
    out = []
    for f in df.schema.fields:
        kind = schema.get(f.name)
        if kind is None and not parse_dates and isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kind = "string"
        out.append(F.col(f"`{f.name}`").try_cast(kind).alias(f.name) if kind is not None else F.col(f"`{f.name}`"))
    if raw is not None and any(k in schema for k in df.columns):
        casts = [source[f"`{f.name}`"].try_cast(schema[f.name] if f.name in schema else f.dataType).alias(f.name) for f in df.schema.fields]
        return source.select(*casts)
    return df.select(*out)


def read_parquet(path: str) -> Frame:
    return Frame(active().read.parquet(path))


def read_csv_async(path: str, **options) -> Future:
    """A future of the frame: schema and types are inferred beside the caller."""
    return _POOL.submit(read_csv, path, **options)


def read_parquet_async(path: str) -> Future:
    return _POOL.submit(read_parquet, path)


def read_json(path: str) -> Frame:
    """One array of objects in a file."""
    return Frame(active().read.option("multiLine", True).json(path))


def read_ndjson(path: str, schema: str | T.StructType | None = None) -> Frame:
    reader = active().read
    return Frame((reader.schema(schema) if schema else reader).json(path))


def write_csv(frame: Frame, path: str, mode: str = "overwrite") -> None:
    frame.df.write.mode(mode).csv(path, header=True)


def write_parquet(frame: Frame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    frame.df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_ndjson(frame: Frame, path: str, mode: str = "overwrite") -> None:
    frame.df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_json(frame: Frame, path: str, mode: str = "overwrite") -> None:
    """Each file one array of objects, streamed by its task."""

    def arrays(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            rows = b.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict({"value": [("[" if first and k == 0 else ",") + r for k, r in enumerate(rows)]})
                first = False
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

    rows = frame.df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(arrays, "value string").write.mode(mode).text(path)
