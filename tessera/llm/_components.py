"""Connected components by alternating large-star and small-star steps over a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import tidy
from ._work import Workspace

#: Edges, once every task has shrunk its own to a forest, that one task finishes (16 MB); beyond it stars alternate.
FEW = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node) with the same components as the edges."""
    if not len(a):
        return a, b
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 2
    for batch in batches:
        held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
        if len(held[0]) > 1 << 20:
            held = list(forest(*held))
            if len(held[0]) > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["u", "v"])
                held = [h[:0] for h in held]
    yield pa.RecordBatch.from_arrays([pa.array(h) for h in forest(*held)], ["u", "v"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], ["u", "v"])


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(id, component_id) for every node of edges (a, b: long): component_id is the smallest node reachable.

    Self-loops and nulls are ignored; an empty table gives an empty result. Nodes without an edge aren't listed.
    Each task first replaces its edges by stars with the same components. Up to FEW of them are finished by one task.
    """
    pairs = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).filter("u <> v")
    now = work.save(pairs.mapInArrow(tidy(_shrink), "u long, v long"), f"{name}-0")
    mark, step = None, 0
    few = now.count() <= FEW
    if few:
        now = work.save(now.coalesce(1).mapInArrow(_finished, "u long, v long"), f"{name}-1")
    while not few:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        step += 1
        after = work.save(small, f"{name}-{step}")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{step - 1}")
        now = after
        if tuple(new) == mark:
            break
        mark = tuple(new)
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return members.union(members.select(F.col("component_id").alias("id"), "component_id").distinct())
