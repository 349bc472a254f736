"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source whose target is r times its size takes every document floor(r) times for certain. What is left is a sample
without replacement, of a fixed size in words, in which a document's chance of inclusion p follows its own size: p =
min(1, L * size), with the L of its source for which the expected words are those that are left. Each document draws u
in (0, 1) and is ranked by (u / (1 - u)) / (p / (1 - p)), the random odds over the odds of inclusion. The sample is the
start of that order that fits what is left; documents further on that still fit the gap follow, in the same order, and
one document closes it. Ranks are found by steps of the order, so no task sorts a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ._bytes import fresh
from ._work import Workspace, small_side

WORD = r"[^\x20\x09-\x0D]+"
#: Steps into which the order of a source is cut; only one step of a source is sorted.
STEPS = 4096
#: How far inclusion odds go, so that a certain or impossible share has a finite rank.
EDGE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed only: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":" + seed))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """(source, source_size) -> also target: sources in code point order, null last, weigh `weights` in turn.

    Targets share the sum of all sizes by weight; one that exceeds max_repeat times its source's size stops there and
    the excess is shared by the others, by weight, until none is above. That is the level L with
    sum(min(L * weight, cap)) = total, found in one pass over sources by rising cap / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_repeat))
    rising = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total - before) / after)
    found = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "source", "level"))).over(Window.partitionBy())
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(found["level"], F.lit(0.0)) * F.col("weight")))
    return s.select("source", "source_size", F.col("target").cast("double").alias("target"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def inclusion(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(l_source, l) of each source of which words are left to sample: see the module.

    Of sizes in falling order, as many are certain as it takes for the next one's L * size to be no more than 1. A
    window holds a source's distinct sizes, which are as many as its longest text has words at most.
    """
    sizes = docs.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).alias("d")
    sizes = sizes.join(plan.select("source", "rest").alias("p"), same("d.source", "p.source")).filter("rest > 0").select("d.source", "size", "n", "rest")
    falling = Window.partitionBy("source").orderBy(F.col("size").desc())
    certain = F.coalesce(F.sum(F.col("size") * F.col("n")).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum(F.col("size") * F.col("size") * F.col("n")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    level = sizes.withColumn("l", (F.col("rest") - certain.cast("double")) / squares.cast("double"))
    return level.filter(F.col("l") * F.col("size") <= 1).groupBy(F.col("source").alias("l_source")).agg(F.max_by("l", "size").alias("l"))


def filled(docs: DataFrame, limit: str) -> DataFrame:
    """docs (source, step, odds, size above 0, doc_id, row), with `fits`: whether the row is in the start of its source's
    order whose sizes add up to `limit` at most. Only the step in which the limit falls is sorted."""
    steps = docs.groupBy("source", "step").agg(F.sum("size").alias("n"), F.first(limit).alias("limit"))
    steps = steps.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("step")))
    cut = steps.filter((F.col("upto") > F.col("limit")) & (F.col("upto") - F.col("n") <= F.col("limit")))
    cut = cut.select(F.col("source").alias("cut_source"), F.col("step").alias("cut_step"), (F.col("upto") - F.col("n")).alias("before"))
    placed = docs.join(cut, same("source", "cut_source"), "left").drop("cut_source")
    order = Window.partitionBy("source").orderBy("odds", "size", F.col("doc_id").asc_nulls_last(), "row")
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    inside = placed.filter("step = cut_step").withColumn("fits", upto <= F.col(limit))
    outside = placed.filter("cut_step is null or step <> cut_step").withColumn("fits", F.col("cut_step").isNull() | (F.col("step") < F.col("cut_step")))
    return inside.unionByName(outside).drop("cut_step", "before")


def mix(df: DataFrame, work: Workspace, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3.0, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row for each row of df: (doc_id, size, source, source_size, target, copies, taken), and row_col where given
    (unique, not null).

    size: words in the text (null: 0). copies: how often the mix holds the document; taken = copies * size.
    Rows are drawn by id, so reruns agree; of equal ids the larger text ranks later. Null ids share one draw. Equal rows
    are ranked one after another. The one rest document whose size comes nearest to the gap that is left closes it, if
    that brings the source nearer to its target: a source misses it by half of its longest document at most.
    No document is taken more than ceil(target / source_size) times; one without words is never sampled. Empty tables
    and sources of no words take nothing.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    docs = work.save(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), number.alias("row")), "sizes")
    plan = source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = work.save(plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "plan")
    level = inclusion(docs, plan)

    p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), F.col("l") * F.col("size")))
    u = draw(F.col("doc_id"), seed)
    ranked = docs.alias("d").join(plan.alias("p"), same("d.source", "p.source")).join(level, same("d.source", "l_source"), "left")
    ranked = ranked.select("d.doc_id", "d.source", "d.size", "d.row", "source_size", "target", "whole", "rest", ((u / (1 - u)) / (p / (1 - p))).alias("odds"))
    ranked = ranked.withColumn("step", F.floor(F.col("odds") / (F.col("odds") + 1) * STEPS))
    first = work.save(filled(ranked.filter("size > 0 and odds is not null"), "rest").select(*ranked.columns, "fits"), "first")
    gaps = first.groupBy(F.col("source").alias("g_source")).agg((F.first("rest") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("gap"))
    left = first.filter("not fits").drop("fits").join(gaps, same("source", "g_source")).drop("g_source")
    second = work.save(filled(left.filter(F.col("size") <= F.col("gap")), "gap").unionByName(left.filter(F.col("size") > F.col("gap")).withColumn("fits", F.lit(False))), "second")
    after = second.groupBy(F.col("source").alias("g_source")).agg((F.first("gap") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("still"))
    spare = second.filter("not fits").join(after, same("source", "g_source")).withColumn("off", F.abs(F.col("still") - F.col("size"))).filter(F.col("off") < F.col("still"))
    closing = spare.groupBy("source").agg(F.min(F.struct("off", "odds", "size", F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("last")).select("last.row")
    sampled = first.filter("fits").select("row").unionByName(second.filter("fits").select("row")).unionByName(closing)
    told = docs.alias("d").join(plan.alias("p"), same("d.source", "p.source")).join(sampled.withColumn("one", F.lit(1)).alias("s"), F.col("d.row") == F.col("s.row"), "left")
    copies = (F.col("whole") + F.coalesce("one", F.lit(0))).cast("long")
    also = [F.col("d.row").alias(row_col)] if row_col else []
    return told.select("d.doc_id", "d.size", "d.source", "source_size", "target", copies.alias("copies"), (copies * F.col("d.size")).alias("taken"), *also)


def mixed_rows(df: DataFrame, work: Workspace, id_col: str = "doc_id", **options) -> DataFrame:
    """df with each row as often as the mix takes it; all columns stay as they are."""
    row, many, before = fresh("row_number", df.columns), fresh("row_copies", df.columns), set(work.names)
    keyed = work.numbered(df, row)
    copies = mix(keyed, work, id_col=id_col, row_col=row, **options).select(row, F.col("copies").alias(many)).filter(F.col(many) > 0)
    copies = work.save(copies, "copies")
    work.finish(before, "numbered", "copies")
    out = keyed.join(small_side(copies), row)
    return out.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col(many).cast("int"))).alias(many)).select(*df.columns)
