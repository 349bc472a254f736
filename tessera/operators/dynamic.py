"""Tumbling, sliding and gapped time windows by bucket arithmetic: closed on either side, both or none."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.duration import fixed_micros

DAY = 86_400_000_000
# Days after Monday of each start.
WEEKDAYS = {"monday": 0, "tuesday": 1, "wednesday": 2, "thursday": 3, "friday": 4, "saturday": 5, "sunday": 6}
WINDOW_STARTS = ("window_bound", "data_point", *WEEKDAYS)
LOWER, UPPER = "_lower_boundary", "_upper_boundary"


def dynamic_windows(df: DataFrame, time: str, every: str | dt.timedelta, period: str | dt.timedelta | None = None, offset: str | dt.timedelta = "0s", by: Sequence[str] = (), closed: str = "left", start_by: str = "window_bound") -> DataFrame:
    """df with each row once for every window that holds it, and the window's bounds as LOWER and UPPER.

    Windows start at every multiple of `every` from the origin plus the offset and last `period`. Of windows that
    overlap, those that start before the one of a group's first row are left out. Rows of a null time are in none.
    """
    step = fixed_micros(every)
    span = step if period is None else fixed_micros(period)
    if step <= 0 or span <= 0:
        raise ValueError("every and period must be above zero")
    shift = fixed_micros(offset)
    keys = [F.col(f"`{c}`") for c in by]
    at = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    out = df.filter(F.col(f"`{time}`").isNotNull()).withColumn("__t", at)
    # each group's first time is needed only where windows start at data points or overlap; it is an aggregate that is
    # joined back, so that rows of a hot group needn't meet in one task: the join splits them, or broadcasts the times
    needs_first = start_by == "data_point" or span > step
    if needs_first:
        least = F.min("__t").alias("__first")
        if by:
            names = [f"__k{k}" for k in range(len(by))]
            firsts = out.groupBy(*[c.alias(n) for c, n in zip(keys, names)]).agg(least)
            out = out.join(firsts, reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(n)) for c, n in zip(keys, names)])).drop(*names)
        else:
            out = out.withColumn("__first", out.agg(least).scalar())
    if start_by == "data_point":
        origin = F.col("__first")
    elif start_by == "window_bound":
        origin = F.lit(0)
    else:
        origin = F.lit((4 + WEEKDAYS[start_by]) * DAY)
    origin = origin + F.lit(shift)
    t = F.col("__t")
    floor = lambda x: x - F.pmod(x - origin, F.lit(step))
    # starts s with: left s <= t < s + span; right s < t <= s + span; both s <= t <= s + span; none s < t < s + span
    last = floor(t) if closed in ("left", "both") else floor(t - 1)
    reach = {"left": t - span + 1, "right": t - span, "both": t - span, "none": t - span + 1}[closed]
    first = floor(reach + step - 1)
    if needs_first:
        low = F.col("__first") if closed in ("left", "both") else F.col("__first") - 1
        first = F.greatest(first, floor(low))
    starts = F.filter(F.sequence(first, F.greatest(last, first), F.lit(step).cast("long")), lambda s: s <= last)
    out = out.withColumn("__s", F.explode(starts))
    lower = F.timestamp_micros("__s").cast("timestamp_ntz")
    upper = F.timestamp_micros(F.col("__s") + span).cast("timestamp_ntz")
    return out.withColumn(LOWER, lower).withColumn(UPPER, upper).drop("__t", "__s", "__first")
