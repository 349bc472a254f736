"""Explode, pivot, unpivot and the three ways to put frames together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct values that a pivot may find for its columns.
MOST_PIVOTED = 10_000


def explode(df: DataFrame, *names: str) -> DataFrame:
    """List columns in lock-step, one row for each item; a null or empty list gives one row of null."""
    if not names:
        return df
    if len(names) == 1:
        return df.select(*[F.explode_outer(f"`{c}`").alias(c) if c == names[0] else F.col(f"`{c}`") for c in df.columns])
    sizes = [F.coalesce(F.array_size(f"`{c}`"), F.lit(0)) for c in names]
    same = F.lit(True)
    for s in sizes[1:]:
        same &= s == sizes[0]
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"`{c}`"), F.array().cast(df.schema[c].dataType)).alias(f"z{k}") for k, c in enumerate(names)])
    checked = F.when(same, zipped).otherwise(F.raise_error(F.lit("exploded lists differ in length")).cast(df.select(zipped.alias("z")).schema[0].dataType))
    inner = df.withColumn("__z", F.explode_outer(checked))
    kind = inner.schema["__z"].dataType.names
    return inner.select(*[F.col("__z")[kind[names.index(c)]].alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def pivot(df: DataFrame, index: Sequence[str], on: str, values: Sequence[str], agg: str = "first", columns: Sequence | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """One row an index, one column for each value of `on` (in ascending order unless listed).

    agg: first, last (both by the order given), sum, min, max, mean, median, count or len.
    """
    if columns is None:
        found = df.select(on).distinct().orderBy(on).limit(MOST_PIVOTED + 1).collect()
        if len(found) > MOST_PIVOTED:
            raise ValueError(f"{on} has more than {MOST_PIVOTED} values")
        columns = [r[0] for r in found]
    by = F.struct(*order) if order else F.lit(0)
    make = {"first": lambda c: F.min_by(c, by) if order else F.first(c), "last": lambda c: F.max_by(c, by) if order else F.last(c), "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "median": F.median, "count": lambda c: F.count(F.lit(1)), "len": lambda c: F.count(F.lit(1))}[agg]
    grouped = df.groupBy(*[F.col(f"`{c}`") for c in index]).pivot(on, list(columns))
    return grouped.agg(*[make(F.col(f"`{v}`")).alias(v) for v in values])


def unpivot(df: DataFrame, index: Sequence[str], on: Sequence[str] = (), variable: str = "variable", value: str = "value") -> DataFrame:
    on = list(on) or [c for c in df.columns if c not in index]
    kinds = {df.schema[c].dataType for c in on}
    if len(kinds) > 1:
        to = "double" if all(isinstance(k, T.NumericType) for k in kinds) else "string"
        df = df.withColumns({c: F.col(f"`{c}`").cast(to) for c in on})
    return df.unpivot([F.col(f"`{c}`") for c in index], [F.col(f"`{c}`") for c in on], variable, value)


def concat_vertical(frames: Sequence[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("nothing to put together")
    first = frames[0]
    for f in frames[1:]:
        if [(x.name, x.dataType) for x in f.schema] != [(x.name, x.dataType) for x in first.schema]:
            raise ValueError("frames differ in their columns")
        first = first.union(f)
    return first


def concat_diagonal(frames: Sequence[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("nothing to put together")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_ordinal(df: DataFrame, order: Sequence[Column], name: str = "__ordinal") -> DataFrame:
    """Rows numbered from 0 in order, without sorting them in one task: ranges are numbered apart and then moved.

    The ranges are checkpointed, since cutting them a second time might cut elsewhere.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp())
    ranged = ranged.checkpoint()
    sizes = ranged.groupBy("__part").count()
    # one row for each partition
    before = sizes.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + place).drop("__part", "__before")


def concat_horizontal(frames: Sequence[DataFrame], orders: Sequence[Sequence[Column]]) -> DataFrame:
    """Side by side by row number in each frame's order; shorter frames end in nulls."""
    names = [c for f in frames for c in f.columns]
    if len(set(names)) != len(names):
        raise ValueError("a column name occurs twice")
    out = None
    for f, order in zip(frames, orders):
        numbered = with_ordinal(f, order)
        out = numbered if out is None else out.join(numbered, "__ordinal", "full")
    return out.select(*names)
