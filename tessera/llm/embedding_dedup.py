"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors of a label are one vector with a count. Each table cuts a label's vectors by the signs of their products
with its own random hyperplanes. Vectors that fall together in some table are compared by their cosine in double
precision; a pair counts in the first table that brings it together. A bucket of many vectors is cut into blocks whose
pairs are separate groups, so no task holds more than two blocks. No pair leaves its task: only sums of links, and a
spanning forest of a group's links.

With b bits a table, vectors at the threshold's angle a meet in it with probability (1 - a / pi) ** b. b follows the
logarithm of the largest label, so buckets stay small at any size, and the number of tables is such that a pair at the
threshold is missed with a probability of at most MISS; closer pairs are missed less.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import pairs_within, tidy
from ._components import components, forest
from ._work import Workspace, per_gb_partitions

MISS = 1e-5
LEAST_BITS = 8
#: Vectors of a bucket's block, and the size up to which groups are compared pair by pair instead of by products.
BLOCK, SMALL = 1024, 48
SEED = 20240305


def tables_for(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors in the largest label."""
    bits = min(60, max(LEAST_BITS, math.ceil(math.log2(max(n, 2)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, vectors = (c for c in batch.columns)
        keys, raws = [], []
        for i, label, v in zip(ids.to_pylist(), labels.to_pylist(), vectors.to_pylist()):
            raw = None
            if i is not None and label is not None and v is not None and None not in v:
                x = np.array(v, dtype=np.float64) + 0.0
                if x.any() and np.isfinite(x).all():
                    raw = x.tobytes()
            raws.append(raw)
            keys.append(None if raw is None else hashlib.blake2b(raw + repr(label).encode(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["id", "label", "key", "vec"])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that neither squares nor their sums overflow or vanish."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            raws = batch.column("vec").to_pylist()
            out = [b""] * len(raws)
            for dim in {len(r) for r in raws}:
                at = [i for i, r in enumerate(raws) if len(r) == dim]
                x = unit(np.frombuffer(b"".join(raws[i] for i in at)).reshape(len(at), dim // 8))
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED).standard_normal((dim // 8, tables * bits))
                signs = (x @ planes[dim] > 0).reshape(len(at), tables, bits)
                for i, h in zip(at, (signs * weights).sum(axis=2)):
                    out[i] = h.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()), pa.array([np.frombuffer(h, "<i8") for h in out], pa.list_(pa.int64()))], [*batch.schema.names, "codes", "hashes"])

    return run


def _linked(threshold: float):
    """Rows come sorted by group; a group that a batch may cut is kept until it's whole (two blocks at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> pa.RecordBatch:
            ids, n, table, block, low, high = (rows.column(c).to_numpy() for c in ("rep", "n", "t", "block", "low", "high"))
            x = [np.frombuffer(v) for v in rows.column("vec").to_pylist()]
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), "<i8").reshape(len(ids), -1)
            group = rows.column("group").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            sizes = np.diff(np.append(first, len(group)))
            hits_i, hits_j = [], []

            def keep(i: np.ndarray, j: np.ndarray) -> None:
                apart = (low[i] == high[i]) | (block[i] != block[j])
                owner = (codes[i] == codes[j]).argmax(axis=1) == table[i]
                hits_i.append(i[apart & owner])
                hits_j.append(j[apart & owner])

            dims = np.array([len(v) for v in x])[first]
            for dim in np.unique(dims[sizes > 1]).tolist():
                small = np.flatnonzero((sizes > 1) & (sizes <= SMALL) & (dims == dim))
                if not len(small):
                    continue
                take = np.concatenate([np.arange(first[g], first[g] + sizes[g]) for g in small])
                u = unit(np.stack([x[k] for k in take]))
                a, b = pairs_within(sizes[small])
                for k in range(0, len(a), 1 << 16):
                    i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                    hit = np.einsum("ij,ij->i", u[i], u[j]) >= threshold
                    keep(take[i[hit]], take[j[hit]])
            for g in np.flatnonzero(sizes > SMALL).tolist():
                rows_g = np.arange(first[g], first[g] + sizes[g])
                u = unit(np.stack([x[k] for k in rows_g]))
                for k in range(0, len(rows_g), 256):
                    i, j = np.nonzero(u[k : k + 256] @ u.T >= threshold)
                    i += k
                    keep(rows_g[i[i < j]], rows_g[j[i < j]])
            i = np.concatenate(hits_i) if hits_i else np.zeros(0, np.int64)
            j = np.concatenate(hits_j) if hits_j else np.zeros(0, np.int64)
            who, inverse = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
            links = np.bincount(inverse, np.concatenate([n[j], n[i]]), minlength=len(who)).astype(np.int64)
            a, b = forest(ids[i], ids[j])
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(who), pa.array(a)]), pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(b)]), pa.concat_arrays([pa.array(links), none])], ["a", "b", "links"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            group = held.column("group").to_numpy()
            whole = int(np.searchsorted(group, group[-1]))
            if whole > 4096:
                yield found(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield found(held)

    return run


def near_duplicates(df: DataFrame, work: Workspace, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row of df: (vec_id, n_links, component_id, kept).

    Two vectors are linked when their labels are equal, their lengths too, and their cosine is at least the threshold.
    A vector with a null id or label, null or of zeros, or with null or non-finite components is linked with nothing:
    it has no links and is its own component. Other columns are not read. An empty table gives an empty result.
    """
    parts = per_gb_partitions(work.spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    keyed = work.save(rows.mapInArrow(tidy(_prepared), "id long, label string, key binary, vec binary"), "vectors")
    reps = keyed.filter("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min("label").alias("label"), F.min("vec").alias("vec"))
    reps = work.save(reps, "representatives")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, threshold)

    hashed = work.save(reps.mapInArrow(tidy(_hashed(bits, tables)), "key binary, rep long, n long, label string, vec binary, codes binary, hashes array<long>"), "hashed")
    placed = hashed.select("rep", F.xxhash64("label", F.octet_length("vec")).alias("kind"), F.posexplode("hashes").alias("t", "h"))
    full = placed.groupBy("kind", "t", "h").agg(F.count("*").alias("size")).filter("size > 1")
    wanted = placed.join(full, ["kind", "t", "h"])
    blocks = F.ceil(F.col("size") / F.lit(BLOCK))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    wanted = wanted.select("rep", "t", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.xxhash64("kind", "t", "h", F.least("block", "other"), F.greatest("block", "other")).alias("group"))
    carried = wanted.join(hashed.select("rep", "n", "vec", "codes"), "rep")
    grouped = carried.repartition(parts, "group").sortWithinPartitions("group")
    found = work.save(grouped.mapInArrow(tidy(_linked(threshold)), "a long, b long, links long"), "found")

    links = found.filter("links is not null").groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("rep"), "links")
    parents = components(found.filter("b is not null"), work, "components").select(F.col("id").alias("rep"), "component_id")
    by_key = reps.select("key", "rep", "n").join(links, "rep", "left").join(parents, "rep", "left")
    by_key = by_key.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component"))
    out = keyed.select("id", "key").join(by_key, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
