"""LM scoring: an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark over all training texts. Each task sorts and counts what it reads, and sends every bucket one
compressed block of sorted keys; a bucket's blocks are merged into sorted arrays, which are written as flat files to the
shared folder. Workers map those files into memory and look words and bigrams up by binary search.

Files: words-<b>: 64-bit hashes of words, sorted, whose place (with the words of earlier buckets) is the word's id;
names-<b>: the 128 bits that tell a word from all others; counts-<b>: their training counts; stats-<b>: per id, how many different words it follows, its count as a context, and
its followers seen once, twice, and more often; pairs-<b>, times-<b>: sorted keys (id << 32 | next id) and their counts.
Counts take the fewest of 1, 2, 4 or 8 bytes that hold a file's largest. The contexts of a bucket are those whose id hashes to it; a context with many rows is spread by the next word too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import mapped, narrow, numbers, opened, put, squeeze, summed
from ._bytes import U64, chunks, mix, tidy, word_ids
from ._work import Workspace, as_bytes, per_gb_partitions

START = 0xFFFFFFFF
#: Tokens that a task counts at once.
FLUSH = 1 << 20


def remainders(ids: list, folds: int) -> np.ndarray:
    return np.array([zlib.crc32(str("null" if i is None else i).encode()) % folds for i in ids], dtype=np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 128 bits and the row of each token: a row's words, then its end, which is zeros as no word is."""
    hi, lo, row = word_ids(data, offsets)
    rows = len(offsets) - 1
    upto = np.searchsorted(row, np.arange(rows), "right")
    return np.insert(hi, upto, U64(0)), np.insert(lo, upto, U64(0)), np.insert(row, upto, np.arange(rows))


def codes(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(hi ^ mix(lo ^ U64(0x3C6EF372FE94F82B)))


def distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in order of their code: code, hi, lo; which one each word is; an order of all, and where each starts in it."""
    code = codes(hi, lo)
    order = np.argsort(code, kind="stable")

    def heads(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(code), dtype=bool)
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
        return new

    new = heads(code, hi, lo)
    if new.sum() != heads(code).sum():
        order = np.lexsort((lo, hi, code))
        new = heads(code, hi, lo)
    first = np.flatnonzero(new)
    inverse = np.empty(len(code), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    lead = order[first]
    return code[lead], hi[lead], lo[lead], inverse, order, first


@dataclass(frozen=True)
class Layout:
    """Where the files are, how many buckets there are, and what a task needs to know of all of them."""

    root: str
    bits: int
    buckets: int
    bases: np.ndarray | None = None
    hot: np.ndarray | None = None

    def file(self, kind: str, b: int) -> str:
        return f"{self.root}/{kind}-{b}"

    def word_bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def pair_bucket(self, keys: np.ndarray) -> np.ndarray:
        first = keys >> U64(32)
        spread = np.isin(first, self.hot) | (first == U64(START))
        return (mix(np.where(spread, keys, first)) % U64(self.buckets)).astype(np.int64)

    def id_bucket(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, ids, "right") - 1


class Files:
    """A worker's maps of the files."""

    _open: dict[str, np.ndarray] = {}

    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        if len(Files._open) > 20_000:
            Files._open.clear()

    def get(self, kind: str, b: int, dtype) -> np.ndarray:
        uri = self.layout.file(kind, b)
        if uri not in Files._open:
            Files._open[uri] = mapped(uri, dtype)
        return Files._open[uri]

    def sized(self, kind: str, b: int, n: int) -> np.ndarray:
        """n numbers, of as many bytes as the file has for each."""
        uri = self.layout.file(kind, b)
        if uri not in Files._open:
            Files._open[uri] = numbers(uri, n)
        return Files._open[uri]

    def ids(self, code: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: never seen in training) and training count of distinct words in order of their codes."""
        ids, counts = np.full(len(code), -1, dtype=np.int64), np.zeros(len(code), dtype=np.int64)
        ends = np.searchsorted(code >> U64(64 - self.layout.bits), np.arange(1 << self.layout.bits), "right")
        start = 0
        for b, end in enumerate(ends.tolist()):
            table = self.get("words", b, "<u8") if end > start else code[:0]
            if len(table):
                names, seen = self.get("names", b, "<u8").reshape(2, -1), self.sized("counts", b, len(table))
                open_, at = np.arange(start, end), np.searchsorted(table, code[start:end])
                # words of one code stand together: go on until the word itself or another code is met
                while len(open_):
                    inside = at < len(table)
                    open_, at = open_[inside], at[inside]
                    same = table[at] == code[open_]
                    open_, at = open_[same], at[same]
                    hit = (names[0][at] == hi[open_]) & (names[1][at] == lo[open_])
                    ids[open_[hit]], counts[open_[hit]] = at[hit] + self.layout.bases[b], seen[at[hit]]
                    open_, at = open_[~hit], at[~hit] + 1
            start = end
        return ids, counts

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """(5, ids): see the module; ids below 0 have zeros."""
        out = np.zeros((5, len(ids)), dtype=np.int64)
        known = np.flatnonzero(ids >= 0)
        bucket = self.layout.id_bucket(ids[known])
        for b in np.unique(bucket).tolist():
            own = known[bucket == b]
            words = len(self.get("words", b, "<u8"))
            out[:, own] = self.sized("stats", b, 5 * words).reshape(5, -1)[:, ids[own] - self.layout.bases[b]]
        return out

    def times(self, keys: np.ndarray) -> np.ndarray:
        """Training count of each of the sorted distinct bigrams."""
        out, bucket = np.zeros(len(keys), dtype=np.int64), self.layout.pair_bucket(keys)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.layout.buckets), "right")
        start = 0
        for b, end in enumerate(ends.tolist()):
            own, start = order[start:end], end
            table = self.get("pairs", b, "<u8") if len(own) else own
            if len(table):
                at = np.minimum(np.searchsorted(table, keys[own]), len(table) - 1)
                out[own] = np.where(table[at] == keys[own], self.sized("times", b, len(table))[at], 0)
        return out


def _training(batches: Iterator[pa.RecordBatch], folds: int, held: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens (128 bits, row) of training texts in pieces."""
    for batch in batches:
        mine = batch.filter(pa.array(remainders(batch.column("id").to_pylist(), folds) != held))
        for _, data, offsets in chunks(mine.column("text")):
            yield tokens(data, offsets)


def _blocks(buckets: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(buckets, kind="stable")
    ids, first = np.unique(buckets[order], return_index=True)
    blobs = [squeeze(*parts) for parts in zip(*[np.split(c[order], first[1:]) for c in columns])] if len(ids) else []
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def summed_words(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (code, hi, lo) and the sums of their counts."""
    code, hi, lo, _, order, first = distinct(hi, lo)
    return code, hi, lo, np.add.reduceat(n[order], first) if len(first) else n


def _count_words(layout: Layout, folds: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            code, hi, lo, n = summed_words(*(np.concatenate(x) for x in zip(*wait)))
            return _blocks(layout.word_bucket(code), code, hi, lo, n)

        for hi, lo, _ in _training(batches, folds, held):
            _, hi, lo, n = summed_words(hi, lo, np.ones(len(hi), dtype=np.uint64))
            wait.append((hi, lo, n))
            size += len(hi)
            if size >= FLUSH:
                yield flush()
                wait.clear()
                size = 0
        if wait:
            yield flush()

    return run


def _merge_words(layout: Layout):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [opened(x, *[np.uint64] * 4)[1:] for x in rows["blob"]]
        code, hi, lo, n = summed_words(*(np.concatenate(x) for x in zip(*parts)))
        put(layout.file("words", key[0]), code.astype("<u8"))
        put(layout.file("names", key[0]), np.stack([hi, lo]).astype("<u8"))
        put(layout.file("counts", key[0]), narrow(n))
        return pd.DataFrame({"bucket": [key[0]], "words": [len(code)], "tokens": [int(n.sum())]})

    return run


def _hot_words(layout: Layout, least: float, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.flatnonzero(numbers(layout.file("counts", b), sizes[b]) > least) + int(layout.bases[b]) for b in batch.column("bucket").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64), pa.int64())], ["id"])

    return run


def pair_keys(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(previous id << 32 | id) of each token; the first of a row has the start before it. Unknown ids become START - 1."""
    own = np.where(ids < 0, START - 1, ids).astype(np.uint64)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.concatenate([[True], row[1:] != row[:-1]])] = U64(START)
    return before << U64(32) | own


def _count_pairs(layout: Layout, folds: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, wait, size = Files(layout), [], 0

        def flush() -> pa.RecordBatch:
            keys, n = summed(np.concatenate([k for k, _ in wait]), np.concatenate([c for _, c in wait]))
            return _blocks(layout.pair_bucket(keys), keys, n)

        for hi, lo, row in _training(batches, folds, held):
            *words, inverse, _, _ = distinct(hi, lo)
            keys, n = np.unique(pair_keys(files.ids(*words)[0][inverse], row), return_counts=True)
            wait.append((keys, n))
            size += len(keys)
            if size >= FLUSH:
                yield flush()
                wait.clear()
                size = 0
        if wait:
            yield flush()

    return run


def _merge_pairs(layout: Layout):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [opened(x, np.uint64, np.int64) for x in rows["blob"]]
        keys, n = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        put(layout.file("pairs", key[0]), keys.astype("<u8"))
        put(layout.file("times", key[0]), narrow(n))
        first, second = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)
        ids, values = summed(first, np.stack([n, n == 1, n == 2, n >= 3], axis=1).astype(np.int64))
        inner = ids != START
        start = values[~inner].sum(axis=0)
        after, follows = summed(second, np.ones(len(second), dtype=np.int64))
        all_ids = np.concatenate([after, ids[inner]])
        table = np.zeros((len(all_ids), 5), dtype=np.int64)
        table[: len(after), 0] = follows
        table[len(after) :, 1:] = values[inner]
        all_ids, table = summed(all_ids, table)
        bucket = layout.id_bucket(all_ids)
        places, at = np.unique(bucket, return_index=True)
        blobs = [squeeze(i.astype(np.uint32), *np.ascontiguousarray(t.T)) for i, t in zip(np.split(all_ids, at[1:]), np.split(table, at[1:]))]
        out = pd.DataFrame({"bucket": places.astype(np.int64), "blob": blobs})
        head = [*start.tolist(), *[int((n == k).sum()) for k in (1, 2, 3, 4)]]
        return pd.concat([out, pd.DataFrame({"bucket": [-1], "blob": [np.array(head, dtype=np.int64).tobytes()]})], ignore_index=True)

    return run


def _merge_stats(layout: Layout, sizes: dict[int, int]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            head = np.sum([np.frombuffer(x, dtype=np.int64) for x in rows["blob"]], axis=0)
            return pd.DataFrame({"bucket": [-1], "sums": [head.tolist()]})
        table = np.zeros((5, sizes[key[0]]), dtype=np.int64)
        for blob in rows["blob"]:
            ids, *values = opened(blob, np.uint32, *[np.int64] * 5)
            table[:, ids.astype(np.int64) - int(layout.bases[key[0]])] += np.stack(values)
        put(layout.file("stats", key[0]), narrow(table))
        after = table[0]
        return pd.DataFrame({"bucket": [key[0]], "sums": [[int(after.sum()), *[int((after == k).sum()) for k in (1, 2, 3, 4)], int((after >= 3).sum())]]})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2, and 3 or more, from how many have count 1, 2, 3 and 4; kept within [0, count]."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    own = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *[min(max(d, 0.05), k - 0.05) for k, d in enumerate(own, 1)]])


@dataclass(frozen=True)
class LanguageModel:
    """What scoring needs besides the files: all small."""

    layout: Layout
    tokens: int
    words: int
    pairs: int
    start: tuple[int, int, int, int]
    high: np.ndarray
    low: np.ndarray
    spare: float

    def score(self, files: Files, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per row: tokens, known tokens, base score, score."""
        rows = len(offsets) - 1
        hi, lo, row = tokens(data, offsets)
        *words, inverse, _, _ = distinct(hi, lo)
        ids, counts = files.ids(*words)
        base = np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        stats = files.stats(ids)
        # by word: its lower-order probability, and as a context its count and the share left to the lower order
        low = np.maximum(stats[0] - self.low[np.minimum(stats[0], 3)], 0.0) / self.pairs if self.pairs else np.zeros(len(ids))
        low = low + self.spare / (self.words + 1)
        total, left = self._context(stats[1:])
        keys = pair_keys(ids[inverse], row)
        first_of_row = keys >> U64(32) == U64(START)
        pairs, back = np.unique(keys, return_inverse=True)
        times = files.times(pairs)[back]
        before = np.roll(inverse, 1)
        s_total, s_left = (x[0] for x in self._context(np.array(self.start, dtype=np.int64).reshape(4, 1)))
        n, share = np.where(first_of_row, s_total, total[before]), np.where(first_of_row, s_left, left[before])
        p = np.maximum(times - self.high[np.minimum(times, 3)], 0.0) / np.maximum(n, 1) + share * low[inverse]
        known = (counts > 0)[inverse]
        return tuple(np.bincount(row, w, minlength=rows) for w in (np.ones(len(row)), known, base[inverse], np.log10(p)))

    def _context(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, once, twice, more = stats
        left = (self.high[1] * once + self.high[2] * twice + self.high[3] * more) / np.maximum(total, 1)
        return total, np.where(total > 0, left, 1.0)


def train(df: DataFrame, work: Workspace, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """Count all texts outside the held-out fold and write the model's files.

    A null or empty text counts as its end alone, a null id falls into the fold of the text "null", and repeated rows
    count each time. Other columns are not read. From an empty table comes a model without words.
    """
    parts = max(16, 2 * per_gb_partitions(work.spark))
    bits = parts.bit_length()
    layout = Layout(work.path("model"), bits, parts)
    rows = df.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    counted = rows.mapInArrow(tidy(_count_words(layout, folds, held)), "bucket long, blob binary")
    sizes = work.save(counted.groupBy("bucket").applyInPandas(_merge_words(layout), "bucket long, words long, tokens long"), "word-sizes")
    listed = {r["bucket"]: r for r in sizes.collect()}
    lengths = [listed[b]["words"] if b in listed else 0 for b in range(1 << bits)]
    for b in range(1 << bits):
        if b not in listed:
            for kind in ("words", "names", "counts"):
                put(layout.file(kind, b), np.zeros(0))
    bases = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    words, total = sum(lengths), sum(r["tokens"] for r in listed.values())
    if words >= START - 1:
        raise ValueError("more words than 32-bit ids")
    layout = Layout(layout.root, bits, parts, bases)
    # no more than 4 contexts a bucket can be above this
    hot = sizes.select("bucket").mapInArrow(_hot_words(layout, total / (4 * parts), lengths), "id long").collect()
    layout = Layout(layout.root, bits, parts, bases, np.array(sorted(r["id"] for r in hot), dtype=np.uint64))
    counted = rows.mapInArrow(tidy(_count_pairs(layout, folds, held)), "bucket long, blob binary")
    merged = work.save(counted.groupBy("bucket").applyInPandas(_merge_pairs(layout), "bucket long, blob binary"), "pair-stats")
    sums = merged.groupBy("bucket").applyInPandas(_merge_stats(layout, {b: n for b, n in enumerate(lengths)}), "bucket long, sums array<long>").collect()
    for b in range(parts):
        for kind in ("pairs", "times"):
            store, path = fs.FileSystem.from_uri(layout.file(kind, b))
            if store.get_file_info(path).type == fs.FileType.NotFound:
                put(layout.file(kind, b), np.zeros(0))
    head = next((r["sums"] for r in sums if r["bucket"] < 0), [0] * 8)
    after = np.array([r["sums"] for r in sums if r["bucket"] >= 0] or [[0] * 6]).sum(axis=0).tolist()
    high, low = discounts(head[4:]), discounts(after[1:5])
    spare = (low[1] * after[1] + low[2] * after[2] + low[3] * after[5]) / after[0] if after[0] else 1.0
    return LanguageModel(layout, total, words, after[0], tuple(head[:4]), high, low, float(spare))


def _scored(model: LanguageModel, folds: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(model.layout)
        for batch in batches:
            ids = batch.column("id")
            out = [model.score(files, data, offsets) for _, data, offsets in chunks(batch.column("text"), 4 << 20)]
            n, known, base, score = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(remainders(ids.to_pylist(), folds) == held), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model.tokens, dtype=np.int64)), pa.array(base), pa.array(score), pa.array(10.0 ** (-score / np.maximum(n, 1)))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return run


def score(df: DataFrame, work: Workspace, model: LanguageModel, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity).

    Tokens are the words (maximal runs of bytes other than 0x20, 0x09-0x0D; A-Z read as a-z) and one end. Scores are
    log10 probabilities. A null or empty text has the end alone. A null id falls into the fold of the text "null".
    Without training rows every probability is 1. Other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text"))
    return rows.mapInArrow(tidy(_scored(model, folds, held)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
