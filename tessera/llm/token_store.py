"""Token-ID output: a content-addressed store of id streams.

Each document's ids, with an end id, are cut into chunks where a rolling hash of the last ids has zero low bits, so
equal passages give equal chunks wherever they stand. A chunk is stored once, under the digest of its bytes. A recipe
lists a document's chunks in order and carries their Merkle root; a manifest carries the root of each recipe file.

Files, all below one folder and in Spark's own formats, so any store that Spark writes will do:
    staged/    kind=0, the chunks: key: 16-byte BLAKE2b of the ids, data: Zstandard of the ids as little-endian unsigned integers
    recipes/   from staged kind=1, in ascending doc_id order: part, doc_id, row, n_tokens, start, keys (joined), root
    manifest/  part, docs, tokens, root (over the part's recipes, in order), itemsize (bytes of an id)
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ._bytes import U64, claim, ends_of, mix, tidy
from ._bytes import chunks as blocks_of
from ._work import Workspace, as_bytes, per_gb_partitions

KEY = 16
#: Ids of the window that the rolling hash sees, and the smallest and largest chunk. A cut falls every MEAN ids or so.
WINDOW, LEAST, MEAN, MOST = 16, 256, 1024, 8192
#: Distinct words whose ids a worker remembers.
REMEMBERED = 2_000_000
#: A space before one of these bytes starts a word in every reading of the pre-tokenizer's white space: visible ASCII,
#: and the first bytes of the letters U+00C0 to U+024F.
SAFE = np.zeros(256, dtype=bool)
SAFE[0x21:0x7F] = True
SAFE[0xC3:0xCA] = True
_GEAR = np.random.default_rng(20240301).integers(0, 2**63, 1 << 16, dtype=np.uint64)


def cuts(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one id stream."""
    n = len(ids)
    if n <= LEAST:
        return np.array([n] if n else [], dtype=np.int64)
    h = _GEAR[ids & 0xFFFF] ^ ids.astype(np.uint64)
    width = 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << U64(width))
        width *= 2
    marks = (np.flatnonzero((h >> U64(40)) % U64(MEAN) == 0) + 1).tolist()
    out, last = [], 0
    for mark in [*marks, n]:
        while mark - last > MOST:
            last += MOST
            out.append(last)
        if mark - last >= LEAST or mark == n and mark > last:
            out.append(mark)
            last = mark
    return np.array(out, dtype=np.int64)


def split_rows(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(ids, np.cumsum(counts)[:-1])


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is. No leaves: the hash of nothing."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=KEY).digest() for x in leaves] or [hashlib.blake2b(digest_size=KEY).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=KEY).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Words:
    """Words that were encoded before, and the ids of all in one pool. Words of up to 16 bytes are told apart by their
    length and bytes, in an open-addressing table; longer ones by their bytes, in a dictionary."""

    SLOTS = 1 << 21

    def __init__(self, dtype: np.dtype) -> None:
        self.slots = np.full(self.SLOTS, -1, dtype=np.int32)
        self.size, self.first, self.last = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)
        self.long: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.size)

    def _slot(self, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (mix(first ^ mix(last + size.astype(np.uint64))) & U64(len(self.slots) - 1)).astype(np.int64)

    def find(self, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Place of each word of up to 16 bytes, -1 for a new one."""
        out, slot, open_ = np.full(len(size), -1, dtype=np.int64), self._slot(size, first, last), np.arange(len(size))
        while len(open_):
            place = self.slots[slot[open_]].astype(np.int64)
            open_, place = open_[place >= 0], place[place >= 0]
            hit = (self.size[place] == size[open_]) & (self.first[place] == first[open_]) & (self.last[place] == last[open_])
            out[open_[hit]] = place[hit]
            open_ = open_[~hit]
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
        return out

    def _enter(self, places: np.ndarray) -> None:
        slot, open_ = self._slot(self.size[places], self.first[places], self.last[places]), np.arange(len(places))
        while len(open_):
            free = open_[self.slots[slot[open_]] < 0]
            self.slots[slot[free]] = places[free]
            won = free[self.slots[slot[free]] == places[free]]
            open_ = np.setdiff1d(open_, won, assume_unique=True)
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)

    def add(self, size: np.ndarray, first: np.ndarray, last: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Put new distinct words in; their places. The table grows, so that half of it at least stays free."""
        place = np.arange(len(self), len(self) + len(size))
        count = np.array(list(map(len, ids)), dtype=np.int64) // self.pool.itemsize
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), self.pool.dtype)])
        self.size, self.first, self.last = (np.concatenate(x) for x in ((self.size, size), (self.first, first), (self.last, last)))
        short = place[size <= 16]
        if 2 * len(self) > len(self.slots):
            while 2 * len(self) > len(self.slots):
                self.slots = np.zeros(2 * len(self.slots), dtype=np.int32)
            self.slots[:] = -1
            short = np.flatnonzero(self.size <= 16)
        self._enter(short)
        return place

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        many = self.count[place]
        stop = np.cumsum(many)
        return self.pool[np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - many - self.start[place], many)], many


class Encoder:
    """A tokenizers file that encodes texts word by word where that is exact, remembering words."""

    _loaded: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        claim("tokens", cls._loaded.clear)
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", False)
        self.words = Words(self.dtype)
        # a piece of a byte-level vocabulary has a character for each of its bytes
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for piece, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(piece)

    def _ids(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def fresh_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words.

        Words that start with a space go many in one call, whose ids are dealt out by the bytes that they stand for.
        """
        out: list[bytes] = [b""] * len(words)
        spaced = [k for k, w in enumerate(words) if w[:1] == b" "]
        for i in range(0, len(spaced), 200 * 64):
            blocks = [spaced[j : j + 200] for j in range(i, min(i + 200 * 64, len(spaced)), 200)]
            texts = [b"".join(map(words.__getitem__, b)).decode() for b in blocks]
            for block, e in zip(blocks, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, dtype=self.dtype)
                ends = np.cumsum([len(words[k]) for k in block])
                last = ((np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * self.dtype.itemsize).tolist()
                raw = ids.tobytes()
                for k, a, b in zip(block, [0, *last], last):
                    out[k] = raw[a:b]
        for k, w in enumerate(words):
            if w[:1] != b" ":
                out[k] = self._ids(w)
        return out

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of whole texts, as the library gives them for each, and how many each has.

        The byte-level pattern never takes a space with what comes before it when a visible character follows, so
        such spaces are safe places to split, and no merge reaches over them.
        """
        raw, rows = data.tobytes(), len(offsets) - 1
        whole = [not self.by_word] * rows
        if self.by_word and any(s in raw for s in self.special):
            whole = [any(s in raw[a:b] for s in self.special) for a, b in zip(offsets[:-1], offsets[1:])]
        valid = True
        try:
            raw.decode()
        except UnicodeDecodeError:
            valid = False
        if not valid:
            whole = [True] * rows
        if len(data):
            split = np.zeros(len(data), dtype=bool)
            split[:-1] = (data[:-1] == 32) & SAFE[data[1:]]
            split[offsets[:-1][offsets[:-1] < len(data)]] = True
            starts = np.flatnonzero(split)
            ends = np.append(starts[1:], len(data))
        else:
            starts = ends = np.zeros(0, np.int64)
        size = ends - starts
        first, last = ends_of(data, starts, ends)
        if len(self.words) > REMEMBERED:
            self.words = Words(self.dtype)
        which, short = np.full(len(starts), -1, dtype=np.int64), size <= 16
        which[short] = self.words.find(size[short], first[short], last[short])
        long = {k: raw[starts[k] : ends[k]] for k in np.flatnonzero(~short).tolist()}
        for k, w in long.items():
            which[k] = self.words.long.get(w, -1)
        missing = np.flatnonzero((which < 0) & short)
        order = missing[np.lexsort((last[missing], first[missing], size[missing]))]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (size[order][1:] != size[order][:-1]) | (first[order][1:] != first[order][:-1]) | (last[order][1:] != last[order][:-1])
        more = {w: k for k, w in long.items() if which[k] < 0}
        lead = np.concatenate([order[new], np.array(list(more.values()), dtype=np.int64)])
        if len(lead):
            words = [raw[a:b] for a, b in zip(starts[lead].tolist(), ends[lead].tolist())]
            places = self.words.add(size[lead], first[lead], last[lead], self.fresh_ids(words))
            which[order] = places[np.cumsum(new) - 1]
            self.words.long.update(zip(more, places[int(new.sum()) :].tolist()))
            for k, w in long.items():
                which[k] = self.words.long[w]
        if len(whole) and all(whole):
            parts = [np.frombuffer(self._ids(raw[a:b]), self.dtype) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        ids, many = self.words.ids(which)
        counts = np.bincount(np.searchsorted(offsets, starts, "right") - 1, many, minlength=rows).astype(np.int64)
        if any(whole):
            at = np.cumsum(counts) - counts
            parts = [np.frombuffer(self._ids(raw[a:b]), self.dtype) if w else ids[k : k + c] for w, a, b, k, c in zip(whole, offsets[:-1], offsets[1:], at, counts)]
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        return ids, counts

    def encode(self, text: str) -> np.ndarray:
        raw = text.encode()
        return self.encode_block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze, seen = Encoder.of(path), zstandard.ZstdCompressor(level=3), set()
        end = np.array([end_id], dtype=encoder.dtype)
        for batch in batches:
            ids, rows = batch.column("id").to_pylist(), batch.column("row").to_pylist()
            chunks, recipes = ([], []), ([], [], [], [])
            streams = (x for _, data, offsets in blocks_of(batch.column("text"), 2 << 20) for x in split_rows(*encoder.encode_block(data, offsets)))
            for doc, row, stream in zip(ids, rows, streams):
                stream = np.concatenate([stream, end])
                raw, keys, last = stream.tobytes(), [], 0
                for cut in (cuts(stream) * encoder.dtype.itemsize).tolist():
                    part, last = raw[last:cut], cut
                    keys.append(key := hashlib.blake2b(part, digest_size=KEY).digest())
                    if key not in seen:
                        if len(seen) > 1 << 20:
                            seen.clear()
                        seen.add(key)
                        chunks[0].append(key)
                        chunks[1].append(squeeze.compress(part))
                for held, x in zip(recipes, (doc, row, len(stream), b"".join(keys))):
                    held.append(x)
            n, m = len(chunks[0]), len(recipes[0])
            keys = [hashlib.blake2b(b"row%d" % r, digest_size=KEY).digest() for r in recipes[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n + [1] * m, pa.int32()), pa.array(chunks[0] + keys, pa.binary()), pa.array([None] * n + recipes[0], pa.int64()), pa.array([None] * n + recipes[1], pa.int64()), pa.array([None] * n + recipes[2], pa.int64()), pa.array(chunks[1] + recipes[3], pa.binary())],
                ["kind", "key", "id", "row", "n_tokens", "data"],
            )

    return run


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle_root([keys[i : i + KEY] for i in range(0, len(keys), KEY)]) for keys in batch.column("keys").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "root"])


def _manifest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("start")
    if (rows["start"].diff().iloc[1:].to_numpy() != rows["n_tokens"].iloc[:-1].to_numpy()).any():
        raise ValueError(f"documents of part {key[0]} don't follow each other")
    return pd.DataFrame({"part": [key[0]], "docs": [len(rows)], "tokens": [int(rows["n_tokens"].sum())], "first": [int(rows["start"].iloc[0])], "root": [merkle_root(list(rows["root"]))]})


MANIFEST = "part int, docs long, tokens long, first long, root binary"


def manifest_of(recipes: DataFrame) -> DataFrame:
    """What a manifest says of these recipes: of each part its documents, tokens, first token and Merkle root."""
    return recipes.select("part", "start", "n_tokens", "root").groupBy("part").applyInPandas(_manifest, MANIFEST)


def checked_itemsize(work: Workspace, root: str) -> int:
    """Bytes of an id, from the store's manifest, which must say what its recipes say and leave no token out."""
    manifest = work.spark.read.parquet(f"{root}/manifest")
    recipes = manifest_of(work.spark.read.parquet(f"{root}/recipes"))
    names = MANIFEST.replace(" int", "").replace(" long", "").replace(" binary", "").split(", ")
    both = manifest.select(*names, F.lit(1).alias("side")).unionByName(recipes.withColumn("side", F.lit(0)))
    if both.groupBy(*names).agg(F.sum("side").alias("listed"), F.count("*").alias("n")).filter("listed <> 1 or n <> 2").limit(1).count():
        raise ValueError("the manifest doesn't match the recipes")
    follows = F.coalesce(F.lag(F.col("first") + F.col("tokens")).over(Window.orderBy("first", "part")), F.lit(0))
    if manifest.select((F.col("first") != follows).alias("off")).filter("off").limit(1).count():
        raise ValueError("parts of the store don't follow each other")
    found = [r[0] for r in manifest.select("itemsize").distinct().collect()]
    return found[0] if found else 2


def staged(work: Workspace, root: str, kind: int) -> DataFrame:
    """The store's chunks (kind 0) or, in no order yet, its recipes (kind 1)."""
    return work.spark.read.schema("key binary, id long, row long, n_tokens long, data binary, kind int").parquet(f"{root}/staged").filter(F.col("kind") == kind)


def write_store(df: DataFrame, work: Workspace, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode df's texts and write the store; returns its folder.

    A null text counts as empty and gives the end id alone. Null ids come first in order; rows of equal ids keep
    the order of the table. Other columns are not read. An empty table gives an empty store.
    """
    spark, root = work.spark, work.path("store")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text"))
    encoded = rows.mapInArrow(tidy(_encoded(tokenizer_path, end_id)), "kind int, key binary, id long, row long, n_tokens long, data binary")
    once = encoded.repartition("key").dropDuplicates(["kind", "key"])
    once.write.mode("overwrite").partitionBy("kind").option("compression", "uncompressed").parquet(f"{root}/staged")
    recipes = staged(work, root, 1).select(F.col("id").alias("doc_id"), "row", "n_tokens", F.col("data").alias("keys"))
    recipes = recipes.mapInArrow(tidy(_roots), "doc_id long, row long, n_tokens long, keys binary, root binary")
    recipes = recipes.repartitionByRange(per_gb_partitions(spark), "doc_id", "row").withColumn("part", F.spark_partition_id())
    recipes = work.save(recipes, "ranged")
    order = Window.partitionBy("part").orderBy("doc_id", "row")
    sums = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = recipes.join(F.broadcast(sums.select("part", "base")), "part").withColumn("place", F.row_number().over(order)).withColumn("start", F.col("base") + F.sum("n_tokens").over(order) - F.col("n_tokens")).drop("base")
    placed.write.mode("overwrite").parquet(f"{root}/recipes")
    back = spark.read.parquet(f"{root}/recipes")
    manifest_of(back).withColumn("itemsize", F.lit(Encoder.of(tokenizer_path).dtype.itemsize)).write.mode("overwrite").parquet(f"{root}/manifest")
    return root


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo the CRC-32 polynomial, bits reflected."""
    a, b = np.broadcast_arrays(a.astype(np.uint32), b.astype(np.uint32))
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def _squares() -> list[np.ndarray]:
    out = [np.array([1 << 30], dtype=np.uint32)]
    for _ in range(40):
        out.append(_times(out[-1], out[-1]))
    return out


_X = _squares()


def crc_after(crc: np.ndarray, more: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of first + second from both CRCs and the second's length."""
    shift, n, k = np.full(len(crc), 1 << 31, dtype=np.uint32), n_bytes.astype(np.int64).copy(), 3
    while n.any():
        odd = (n & 1).astype(bool)
        if odd.any():
            shift[odd] = _times(_X[k], shift[odd])
        n >>= 1
        k += 1
    return _times(shift, crc) ^ more.astype(np.uint32)


def _read_chunks(itemsize: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            n, crc = [], []
            for key, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist()):
                part = opened.decompress(data)
                if hashlib.blake2b(part, digest_size=KEY).digest() != key:
                    raise ValueError(f"chunk {key.hex()} doesn't match its key")
                ids = np.frombuffer(part, f"<u{itemsize}")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["key", "n", "crc"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        rows = {c: [] for c in ("row", "seq", "key")}
        for row, keys, root in zip(*(batch.column(names.index(c)).to_pylist() for c in ("row", "keys", "root"))):
            parts = [keys[i : i + KEY] for i in range(0, len(keys), KEY)]
            if merkle_root(parts) != root:
                raise ValueError(f"recipe {row} doesn't match its root")
            rows["row"] += [row] * len(parts)
            rows["seq"] += range(len(parts))
            rows["key"] += parts
        yield pa.RecordBatch.from_arrays([pa.array(rows["row"], pa.int64()), pa.array(rows["seq"], pa.int64()), pa.array(rows["key"], pa.binary())], ["row", "seq", "key"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, lists = batch.column("row"), batch.column("parts").to_pylist()
        parts = [[(p["n"], p["crc"]) for p in sorted(x, key=lambda p: p["seq"])] for x in lists]
        n, crc = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.uint32)
        for seq in range(max(map(len, parts), default=0)):
            at = [i for i, p in enumerate(parts) if len(p) > seq]
            more = np.array([parts[i][seq] for i in at], dtype=np.int64)
            crc[at] = crc_after(crc[at], more[:, 1], more[:, 0] * 4)
            n[at] += more[:, 0]
        yield pa.RecordBatch.from_arrays([rows, pa.array(n), pa.array(crc.astype(np.int64))], ["row", "n", "crc"])


def read_store(work: Workspace, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: every chunk is opened and checked
    against its key, every recipe against its root, all roots against the manifest, and the ids of a document are
    those of its chunks in order."""
    spark, itemsize = work.spark, checked_itemsize(work, root)
    recipes = spark.read.parquet(f"{root}/recipes")
    chunks = staged(work, root, 0).select("key", "data").mapInArrow(tidy(_read_chunks(itemsize)), "key binary, n long, crc long")
    listed = recipes.select("row", "keys", "root").mapInArrow(tidy(_exploded), "row long, seq long, key binary")
    parts = listed.join(chunks, "key", "left").groupBy("row").agg(F.collect_list(F.struct("seq", F.coalesce("n", F.raise_error(F.lit("a chunk is missing")).cast("long")).alias("n"), "crc")).alias("parts"))
    whole = parts.mapInArrow(tidy(_joined), "row long, n long, crc long")
    return recipes.select("doc_id", "start", "row").join(whole, "row").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def read_ids(work: Workspace, root: str) -> DataFrame:
    """(doc_id, ids) of each document, put together from its chunks."""
    spark, itemsize = work.spark, checked_itemsize(work, root)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            lists = [np.frombuffer(b"".join(opened.decompress(p["data"]) for p in sorted(x, key=lambda p: p["seq"])), f"<u{itemsize}").tolist() for x in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lists, pa.list_(pa.int64()))], ["row", "ids"])

    recipes = spark.read.parquet(f"{root}/recipes")
    listed = recipes.select("row", "keys", "root").mapInArrow(tidy(_exploded), "row long, seq long, key binary")
    chunks = staged(work, root, 0).select("key", "data")
    parts = listed.join(chunks, "key").groupBy("row").agg(F.collect_list(F.struct("seq", "data")).alias("parts"))
    return recipes.select("doc_id", "row").join(parts.mapInArrow(tidy(joined), "row long, ids array<long>"), "row").select("doc_id", "ids")
