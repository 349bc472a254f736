"""As-of join: each left row meets the right row whose key is nearest before, after, or either way.

Both sides are put in one ordered sequence a group, and each left row takes the last right row before it (or the first
after it). This is one shuffle by the group and a running aggregate, no range join. Where there are no groups, or a few hold
most rows, the sequence is cut at quantiles of the key into slices that are worked on apart; what a slice's rows may find in
the slices before and after it is the greatest and least right row of those, one row a group and slice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.duration import fixed_micros

#: Slices of the sequence are ROOT * ROOT, so that a row finds its own among sorted bounds in two steps.
ROOT = 32
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _number(c: Column, kind: T.DataType) -> Column:
    return F.unix_micros(c.cast("timestamp")) if isinstance(kind, TIMES) else c


def _sliced(both: DataFrame) -> DataFrame:
    """both with its slice as p: how many of ROOT * ROOT - 1 quantiles of t are at or below t; 0 for a null."""
    cuts = ROOT * ROOT
    ranks = F.array(*[F.lit(k / cuts) for k in range(1, cuts)])
    bounds = both.agg(F.array_sort(F.percentile_approx("t", ranks)).alias("q")).scalar()
    below = lambda q: F.size(F.filter(q, lambda x: x <= F.col("t")))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(ROOT - 1)), lambda k: F.get(F.col("q"), k * ROOT - 1))
    at = both.withColumn("q", F.coalesce(bounds, F.array().cast(T.ArrayType(both.schema["t"].dataType)))).withColumn("c", below(coarse) * ROOT)
    return at.withColumn("p", F.col("c") + below(F.slice("q", F.col("c") + 1, F.lit(ROOT - 1)))).drop("q", "c")


def _carried(both: DataFrame, groups: Sequence[str]) -> DataFrame:
    """For each group and slice the last right row of all slices before (sb) and the first of all after (sf).

    Without groups this is a table of ROOT * ROOT rows at most, and so its window in one task and its broadcast are bounded.
    """
    ends = both.groupBy(*groups, "p").agg(F.max("s").alias("high"), F.min("s").alias("low"))
    w = Window.partitionBy(*groups).orderBy("p")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    found = ends.select(*groups, "p", F.max("high").over(before).alias("sb"), F.min("low").over(after).alias("sf"))
    return found if groups else F.broadcast(found)


def join_asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by_left: Sequence[str] = (), by_right: Sequence[str] = (), strategy: str = "backward", tolerance: str | int | float | dt.timedelta | None = None, sliced: bool | None = None) -> DataFrame:
    """All left rows with the right row's columns, null where none is within the tolerance, which is inclusive.

    Equal keys match. Of right rows with equal keys the one latest in order of all its columns is taken looking back, the
    earliest looking ahead. Nearest takes the earlier of two at equal distance. Null keys match nothing. The right side's
    key columns are dropped; names that the left side has get the suffix `_right`. `sliced` cuts long sequences into parts
    at the cost of reading both sides a second and third time; by default it does so where there are no groups, and is worth
    asking for where a few groups hold most rows. Results are the same either way.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown strategy {strategy!r}")
    kind = left.schema[left_on].dataType
    limit = None if tolerance is None else fixed_micros(tolerance) if isinstance(kind, TIMES) else float(tolerance) if not str(tolerance).lstrip("-").isdigit() else int(tolerance)
    groups = [f"__by_{k}" for k in range(len(by_left))]
    extra = [c for c in right.columns if c not in (right_on, *by_right)]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"v{k}") for k, c in enumerate(extra)], F.lit(1).alias("present"))
    lefts = left.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(left.columns)]).alias("l"), *[F.col(f"`{c}`").alias(g) for c, g in zip(by_left, groups)], _number(F.col(f"`{left_on}`"), kind).alias("t"), F.lit(None).cast(right.select(packed.alias("r")).schema[0].dataType).alias("r"))
    rights = right.filter(F.col(f"`{right_on}`").isNotNull()).select(F.lit(None).cast(lefts.schema["l"].dataType).alias("l"), *[F.col(f"`{c}`").alias(g) for c, g in zip(by_right, groups)], _number(F.col(f"`{right_on}`"), right.schema[right_on].dataType).alias("t"), packed.alias("r"))
    both = lefts.unionByName(rights).withColumn("s", F.when(F.col("r").isNotNull(), F.struct("t", "r")))
    is_left = F.col("r").isNull()
    parts = list(groups)
    if not groups if sliced is None else sliced:
        both = _sliced(both)
        parts.append("p")
        both = both.join(_carried(both, groups), parts, "left")
    before = Window.partitionBy(*parts).orderBy(F.col("t"), is_left, F.col("r")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*parts).orderBy(F.col("t"), ~is_left, F.col("r")).rowsBetween(0, Window.unboundedFollowing)
    found = lambda here, carried: F.coalesce(here, carried) if "p" in parts else here
    if strategy != "forward":
        both = both.withColumn("b", found(F.last("s", ignorenulls=True).over(before), F.col("sb")))
    if strategy != "backward":
        both = both.withColumn("f", found(F.first("s", ignorenulls=True).over(after), F.col("sf")))
    both = both.filter(F.col("l").isNotNull())
    near = F.col("b") if strategy == "backward" else F.col("f") if strategy == "forward" else F.when(F.col("b").isNull() | (F.col("f")["t"] - F.col("t") < F.col("t") - F.col("b")["t"]), F.coalesce("f", "b")).otherwise(F.col("b"))
    both = both.withColumn("m", near)
    ok = F.col("m").isNotNull() & F.col("t").isNotNull()
    for g in groups:
        ok &= F.col(g).isNotNull()
    if limit is not None:
        ok &= F.abs(F.col("m")["t"] - F.col("t")) <= limit
    taken = set(left.columns)
    names = [c + "_right" if c in taken else c for c in extra]
    return both.select(*[F.col("l")[f"c{k}"].alias(c) for k, c in enumerate(left.columns)], *[F.when(ok, F.col("m")["r"][f"v{k}"]).alias(n) for k, n in enumerate(names)])
