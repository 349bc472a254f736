"""Exact dedup: per-partition counting quotient filters, merged by sorted remainders, then byte verification.

Every task digests its rows and packs their 64-bit fingerprints into counting quotient filters, one for each range of
fingerprints. The filters of a range merge without loss, since quotient and remainder give the fingerprint back.
Only rows whose fingerprint is counted more than once go on, and are grouped by their normalised bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U64, fresh, tidy
from ._work import Workspace, as_bytes, per_gb_partitions, semi_join, small_side

#: Rows whose fingerprints one task holds before it packs them.
FLUSH_ROWS = 1 << 20


class CountingQuotientFilter:
    """A multiset of 64-bit fingerprints: a bit for each occupied quotient, a run of sorted remainders below each,
    and a counter beside each remainder."""

    def __init__(self, bits: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.bits, self.occupied, self.run_ends, self.remainders, self.counts = bits, occupied, run_ends, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, low: int = 0, width: int = 64) -> CountingQuotientFilter:
        """From fingerprints in [low, low + 2**width)."""
        values, inverse = np.unique(fingerprints, return_inverse=True)
        return cls.from_sorted(values, np.bincount(inverse, weights=counts, minlength=len(values)).astype(np.int64), low, width)

    @classmethod
    def from_sorted(cls, values: np.ndarray, n: np.ndarray, low: int = 0, width: int = 64) -> CountingQuotientFilter:
        """From distinct fingerprints in order, and their counts."""
        bits = min(width, max(3, int(len(values)).bit_length() + 1))
        rest = width - bits
        quotient = ((values - U64(low)) >> U64(rest)).astype(np.int64) if rest < 64 else np.zeros(len(values), np.int64)
        occupied = np.zeros(1 << bits, dtype=bool)
        occupied[quotient] = True
        ends = np.ones(len(values), dtype=bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        return cls(bits, occupied, ends, values & U64((1 << rest) - 1), n)

    def fingerprints(self, low: int = 0, width: int = 64) -> np.ndarray:
        """All fingerprints, in order: the k-th run of remainders belongs to the k-th occupied quotient."""
        run = np.cumsum(self.run_ends) - self.run_ends
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotient << U64(width - self.bits)) + self.remainders + U64(low)

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter], low: int = 0, width: int = 64) -> CountingQuotientFilter:
        """Sum of the multisets: two neighbours' runs at a time are merged in order, never sorted again."""
        lists = [(f.fingerprints(low, width), f.counts) for f in filters]
        while len(lists) > 1:
            lists = [merge(*lists[i], *lists[i + 1]) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
        return cls.from_sorted(*lists[0], low, width)

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, len(self.remainders)], dtype="<i8").tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.run_ends).tobytes() + self.remainders.astype("<u8").tobytes() + self.counts.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, n = (int(x) for x in np.frombuffer(data, "<i8", 2))
        at, slots = 16, 1 << bits
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, slots // 8, at), count=slots).astype(bool)
        at += slots // 8
        ends = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        at += (n + 7) // 8
        return cls(bits, occupied, ends, np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64))


def merge(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ordered lists of distinct values as one, counts of values that both have added."""
    at = np.searchsorted(a, b)
    both = np.zeros(len(b), dtype=bool)
    inside = at < len(a)
    both[inside] = a[at[inside]] == b[inside]
    m = m.copy()
    m[at[both]] += n[both]
    return np.insert(a, at[~both], b[~both]), np.insert(m, at[~both], n[~both])


def normalise(text: bytes) -> bytes:
    """Each run of 0x20 and 0x09-0x0D becomes one space."""
    body = b" ".join(text.split())
    if not text:
        return text
    if not body:
        return b" "
    return b" " * (text[0] in b"\x20\x09\x0a\x0b\x0c\x0d") + body + b" " * (text[-1] in b"\x20\x09\x0a\x0b\x0c\x0d")


def _digests(shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            fp = np.concatenate(held) if held else np.zeros(0, np.uint64)
            block = (fp >> U64(shift)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            ids, first = np.unique(block[order], return_index=True)
            parts = np.split(fp[order], first[1:])
            blobs = [CountingQuotientFilter.of(p, None, int(b) << shift, shift).to_bytes() for b, p in zip(ids.tolist(), parts) if len(p)]
            none = pa.nulls(len(blobs), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(blobs), pa.string()), pa.array(ids[: len(blobs)]), pa.array(blobs, pa.binary())], ["row", "id", "fp", "sha", "block", "filter"])

        for batch in batches:
            digests = [hashlib.sha256(normalise(t)) for t in batch.column("text").to_pylist()]
            fp = np.frombuffer(b"".join(d.digest()[:8] for d in digests), dtype="<u8")
            held.append(fp)
            n = len(fp)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(fp.view(np.int64)), pa.array([d.hexdigest() for d in digests], pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["row", "id", "fp", "sha", "block", "filter"])
            if sum(map(len, held)) >= FLUSH_ROWS:
                yield packed()
                held.clear()
        yield packed()

    return run


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normalise(t) for t in batch.column("text").to_pylist()]
        fp = np.frombuffer(b"".join(hashlib.sha256(t).digest()[:8] for t in texts), dtype="<u8")
        yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(texts, pa.binary())], ["fp", "norm"])


def _repeated(shift: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low = int(key[0]) << shift
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(x) for x in rows["filter"]], low, shift)
        return pd.DataFrame({"fp": whole.fingerprints(low, shift)[whole.counts > 1].astype(np.uint64).view(np.int64)})

    return run


def exact_dedup(df: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each row of df: (row, id, keep_id, group_size, kept, text_sha256).

    Texts are equal when their bytes are after each run of 0x20, 0x09-0x0D has become one space; null counts as empty.
    Of equal texts the row with the smallest id is kept; a null id comes last, and of repeated rows one is kept.
    `row` is row_col where given (unique, not null), else a number given here. Other columns are not read.
    An empty table gives an empty result.
    """
    blocks = max(3, (4 * per_gb_partitions(work.spark)).bit_length())
    shift = 64 - blocks
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = df.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text"))
    digested = work.save(rows.mapInArrow(tidy(_digests(shift)), "row long, id long, fp long, sha string, block long, filter binary"), "digests")
    docs = digested.filter("block is null").select("row", "id", "fp", "sha")
    filters = digested.filter("block is not null").select("block", "filter")
    repeated = work.save(filters.groupBy("block").applyInPandas(_repeated(shift), "fp long"), "repeated")

    texts = df.select(as_bytes(text_col).alias("text")).mapInArrow(tidy(_normalised), "fp long, norm binary")
    classes = semi_join(texts, repeated, "fp").groupBy("fp", "norm").agg(F.count("*").alias("n")).select("fp", F.sha2("norm", 256).alias("sha"), "n")
    groups = semi_join(docs, repeated, "fp").groupBy("fp", "sha").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("keep"))
    groups = groups.join(classes, ["fp", "sha"]).select("fp", "sha", "keep", "n")
    out = docs.join(groups, ["fp", "sha"], "left")
    single = F.col("n").isNull()
    return out.select(
        "row",
        "id",
        F.when(single, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(single, F.lit(True)).otherwise(F.col("keep.row") == F.col("row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_dedup drops; all columns stay as they are."""
    row, before = fresh("row_number", df.columns), set(work.names)
    keyed = work.numbered(df, row)
    dropped = exact_dedup(keyed, work, id_col, text_col, row).filter("not kept").select(F.col("row").alias(row))
    dropped = work.save(dropped, "dropped")
    work.finish(before, "numbered", "dropped")
    return keyed.join(small_side(dropped), row, "left_anti").select(*df.columns)
