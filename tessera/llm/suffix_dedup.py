"""Suffix-array dedup: maximal repeats from the interval tree of an enhanced suffix array.

Every window of LENGTH bytes has a minimiser: the least hash of its GRAM-byte strings. Equal windows have equal
minimisers, so texts are cut into segments of consecutive windows with one minimiser, and equal windows meet where the
segments of a minimiser meet. A first pass finds the minimisers that more than one document has, a second sends their
segments, equal ones of a task but once.

Where segments meet, suffixes are sorted with their common prefixes (the enhanced suffix array), and a stack scan of the
prefix lengths walks the tree of common-prefix intervals. An interval whose suffixes have different bytes before them, or
start a segment, can't be extended to the left: it is a maximal repeat, with all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import mapped, opened, put, squeeze
from ._bytes import BYTE_HASH, U64, chunks, column_bytes, member, mix, powers, rolling_hashes, tidy
from ._work import Workspace, as_bytes, per_gb_partitions

LENGTH, GRAM = 50, 20
#: Bytes of a suffix that are sorted, and steps at which a segment's suffix counts as its start: a repeat is found from
#: the last such step before it, so DEPTH >= STEP + LENGTH.
DEPTH, STEP = 96, 32
#: Minimisers that a task gathers before it sends a block; bytes of segments, and of texts, handled at once.
FLUSH, SEGMENT_BYTES, PIECE = 1 << 20, 1 << 20, 1 << 19
#: Shared minimisers that are broadcast at most (64 MB); beyond it tasks map filters of them from the shared folder, one
#: for each SLICE of them or so, and a filter has at least FILTER_BITS bits a minimiser.
SHARED, SLICE, FILTER_BITS = 8 << 20, 4 << 20, 8
#: Rows whose spans are one file.
BLOCK = 4096
LAST = (1 << 63) - 1


def window_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: first window, last window, row, minimiser. Windows don't leave their row."""
    n, width = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_HASH[data] * powers(n), out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * powers(n + 1, inverse=True)[: n + 1 - GRAM]
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    least, span = h, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(h) - width + 1], least[width - span :])
    lengths = np.diff(offsets)
    long = lengths >= LENGTH
    starts, stops = offsets[:-1][long], offsets[1:][long] - LENGTH + 1
    new = np.ones(len(least), dtype=bool)
    new[1:] = least[1:] != least[:-1]
    new[starts] = True
    inside = np.zeros(len(least) + 1, dtype=np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, stops, -1)
    inside = np.cumsum(inside[:-1]) > 0
    first = np.flatnonzero(new & inside)
    # a run ends before the next one, or where its row's windows end
    row = np.searchsorted(offsets, first, "right") - 1
    last = np.append(first[1:], n) - 1
    last = np.minimum(last, offsets[row + 1] - LENGTH)
    return first, last, row, least[first]


def _block_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U64(64 - bits)).astype(np.int64)


def _gathered(bits: int):
    """Blocks of a task's minimisers, each flagged if several documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            k, o = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(k, kind="stable")
            k, o = k[order], o[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            many = (np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)).astype(np.uint8)
            k = k[first]
            ids, at = np.unique(_block_of(k, bits), return_index=True)
            blobs = [squeeze(a, b) for a, b in zip(np.split(k, at[1:]), np.split(many, at[1:]))]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(blobs, pa.binary())], ["block", "blob"])

        for batch in batches:
            ids = batch.column("id").to_numpy()
            for part, data, offsets in chunks(batch.column("text"), PIECE):
                _, _, row, key = window_runs(data, offsets)
                keys.append(key)
                owners.append(ids[part][row])
            if sum(map(len, keys)) > FLUSH:
                yield block()
                keys.clear()
                owners.clear()
        if sum(map(len, keys)):
            yield block()

    return run


def _shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    parts = [opened(x, np.uint64, np.uint8) for x in rows["blob"]]
    k, many = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")
    k, many = k[order], many[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    shared = k[first][(np.diff(np.append(first, len(k))) > 1) | (np.maximum.reduceat(many, first) > 0)]
    return pd.DataFrame({"block": [key[0]], "n": [len(shared)], "blob": [squeeze(shared)]})


class Filters:
    """Bit filters of shared minimisers, as files in the shared folder. All shared ones pass, and a few per cent of the
    others: their segments meet nobody."""

    def __init__(self, root: str, total: int) -> None:
        self.root, self.slice_bits = root, max(0, (max(total, 1) - 1) // SLICE).bit_length()
        self.size = 1 << max(6, ((FILTER_BITS * total >> self.slice_bits) - 1).bit_length())
        self.present: list[int] = []

    def slices(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> U64(63 - self.slice_bits) >> U64(1)).astype(np.int64)

    def places(self, mixed: np.ndarray) -> list[np.ndarray]:
        return [((mixed >> U64(shift)) & U64(self.size - 1)).astype(np.int64) for shift in (0, 28)]

    def dealt(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                keys = opened(blob, np.uint64)[0]
                own = self.slices(mix(keys))
                ids = np.unique(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([squeeze(keys[own == k]) for k in ids], pa.binary())], ["slice", "blob"])

    def written(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(self.size, dtype=bool)
        for blob in rows["blob"]:
            for at in self.places(mix(opened(blob, np.uint64)[0])):
                held[at] = True
        put(f"{self.root}/{key[0]}", np.packbits(held, bitorder="little"))
        return pd.DataFrame({"slice": [key[0]]})

    def build(self, shared: DataFrame) -> Filters:
        dealt = shared.select("blob").mapInArrow(tidy(self.dealt), "slice long, blob binary")
        self.present = [r["slice"] for r in dealt.groupBy("slice").applyInPandas(lambda key, rows: self.written(key, rows), "slice long").collect()]
        return self

    def open(self):
        """The test of keys, in a task."""
        files = {k: mapped(f"{self.root}/{k}", np.uint8) for k in self.present}

        def passes(keys: np.ndarray) -> np.ndarray:
            mixed, hit = mix(keys), np.zeros(len(keys), dtype=bool)
            own = self.slices(mixed)
            for k in np.unique(own).tolist():
                if k in files:
                    mine = np.flatnonzero(own == k)
                    hit[mine] = np.logical_and.reduce([files[k][at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in self.places(mixed[mine])])
            return hit

        return passes


def _sender(shared):
    """Which keys a task sends segments of: those in a broadcast table, those that pass filters, or all (None)."""
    if shared is None:
        return lambda keys: np.ones(len(keys), dtype=bool)
    if isinstance(shared, Filters):
        return shared.open()
    return lambda keys: member(keys, shared.value)


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Spans of all blobs, overlapping or touching ones joined."""
    return unpacked(np.zeros(len(blobs), dtype=np.int64), pa.array(blobs, pa.binary()))[1:]


def unpacked(rows: np.ndarray, blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the rows' blobs in order of row and start, overlapping or touching ones of a row joined."""
    data, offsets = column_bytes(blobs)
    both = np.frombuffer(data.tobytes(), "<u4").reshape(-1, 2).astype(np.int64)
    return joined(np.repeat(rows, np.diff(offsets) // 8), both[:, 0], both[:, 1])


def joined(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order of row and start, overlapping or touching ones of a row joined."""
    if not len(rows):
        return rows, starts, ends
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    # a row's spans lie above those of the row before
    lift = np.cumsum(np.concatenate([[0], rows[1:] != rows[:-1]])) << 33
    reach = np.maximum.accumulate(ends + lift)
    new = np.concatenate([[True], starts[1:] + lift[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)
    return rows[new], starts[new], (reach - lift)[last]


def by_row(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct rows, and each one's joined spans as pairs of unsigned 32-bit integers."""
    rows, starts, ends = joined(rows, starts, ends)
    own, first = np.unique(rows, return_index=True)
    data = np.stack([starts, ends], axis=1).astype("<u4").tobytes()
    return own, pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.append(first * 8, len(data)).astype(np.int32).tobytes()), pa.py_buffer(data)])


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of these sizes (above 0) that start at a and at b have the same bytes."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    ends = np.cumsum(size)
    inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
    return np.logical_and.reduceat(data[inside + np.repeat(a, size)] == data[inside + np.repeat(b, size)], ends - size)


def _segments(shared):
    """Of each flush, the segments that may hold repeats (key, id, row, starts, bytes), and spans already known to be
    copies of a smaller document's in the same flush (key: the row, bytes null, spans)."""
    names = ["key", "id", "row", "starts", "segment", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _sender(shared)
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            data = np.concatenate([h[0] for h in held])
            base = np.cumsum([0] + [len(h[0]) for h in held])
            first, size, key, id_, row, place = (np.concatenate(x) for x in zip(*[(h[1] + b, h[2], *h[3:]) for h, b in zip(held, base)]))
            same = rolling_hashes(data, first, first + size) ^ key
            # occurrences of one segment stand together, the smallest document's first
            order = np.lexsort((place, row, id_, same))
            same, id_, row, place = same[order], id_[order], row[order], place[order]
            first, size, key = first[order], size[order], key[order]
            group = np.cumsum(np.concatenate([[True], same[1:] != same[:-1]])) - 1
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            # equal hashes only bring segments together: a copy has the bytes of its group's head
            lead = head[group]
            copy = (id_ > id_[lead]) & (size == size[lead])
            at = np.flatnonzero(copy)
            copy[at] = equal_spans(data, first[at], first[lead[at]], size[at])
            rows, blobs = by_row(row[copy], place[copy], (place + size)[copy])
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.nulls(n, pa.int64()), pa.array(rows), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary()), blobs], names)
            # the rest, one row for each segment and document row
            keep = np.flatnonzero(~copy)
            own = np.zeros(len(keep), dtype=bool)
            own[1:] = (group[keep][1:] == group[keep][:-1]) & (row[keep][1:] == row[keep][:-1]) & (size[keep][1:] == size[keep][:-1])
            at = np.flatnonzero(own)
            own[at] = equal_spans(data, first[keep][at], first[keep][at - 1], size[keep][at])
            new = ~own
            lead = keep[new]
            at = np.flatnonzero(new)
            starts = pa.ListArray.from_arrays(pa.array(np.append(at, len(keep)).astype(np.int32)), pa.array(place[keep].astype(np.int32)))
            ends = np.concatenate([[0], np.cumsum(size[lead])])
            source = np.arange(ends[-1]) - np.repeat(ends[:-1], size[lead]) + np.repeat(first[lead], size[lead])
            raw = pa.Array.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[source].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(key[lead].view(np.int64)), pa.array(id_[lead]), pa.array(row[lead]), starts, raw, pa.nulls(len(lead), pa.binary())], names)

        for batch in batches:
            ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            for part, data, offsets in chunks(batch.column("text"), PIECE):
                first, last, row, key = window_runs(data, offsets)
                hit = sent(key)
                first, last, row, key = first[hit], last[hit], row[hit], key[hit]
                if not len(first):
                    continue
                size = last - first + LENGTH
                ends = np.cumsum(size)
                source = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(first, size)
                held.append((data[source], ends - size, size, key, ids[part][row], rows[part][row], first - offsets[row]))
                if sum(len(h[0]) for h in held) > SEGMENT_BYTES:
                    yield from flush()
                    held.clear()
        if held:
            yield from flush()

    return run


def repeats(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, groups: bool = False):
    """Maximal repeats of at least LENGTH bytes among segments of one buffer that more than one id has.

    Gives positions, and for each the length of its longest repeat that a smaller id has too (0: none). With groups,
    also a list of (length, positions): all maximal repeats with all their occurrences, up to DEPTH bytes.
    """
    n = len(data)
    sizes = np.diff(offsets)
    seg = np.repeat(np.arange(len(sizes)), sizes)
    rest = offsets[1:][seg] - np.arange(n)
    at = np.flatnonzero(rest >= LENGTH)
    none = np.zeros(0, np.int64)
    if not len(at):
        return (none, none, []) if groups else (none, none)
    owner = ids[seg]
    # windows are grouped by a hash first: only those that several ids have, and that can't be extended to the left
    # in all their places, are sorted as suffixes
    h = rolling_hashes(data, at, at + LENGTH)
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(head, len(h)))
    place = at - offsets[seg[at]]
    left = np.where(place % STEP == 0, -1, data[np.maximum(at, 1) - 1].astype(np.int64))
    lo, hi = np.minimum.reduceat(left, head), np.maximum.reduceat(left, head)
    o = owner[at]
    useful = (np.minimum.reduceat(o, head) != np.maximum.reduceat(o, head)) & ((lo != hi) | (lo < 0))
    keep = np.repeat(useful, count)
    at, left = at[keep], left[keep]
    if not len(at):
        return (none, none, []) if groups else (none, none)
    # the enhanced suffix array of what is left
    length = np.minimum(rest[at], DEPTH)
    padded = np.concatenate([data, np.zeros(DEPTH, dtype=np.uint8)])
    words = []
    for k in range(0, DEPTH, 8):
        w = np.zeros(len(at), dtype=np.uint64)
        for j in range(k, k + 8):
            w = w << U64(8) | np.where(length > j, padded[at + j], 0).astype(np.uint64)
        words.append(w)
    order = np.lexsort((length, *words[::-1]))
    at, left, length, words = at[order], left[order], length[order], [w[order] for w in words]
    lcp, same = np.zeros(len(at), dtype=np.int64), np.ones(len(at) - 1, dtype=bool)
    for w in words:
        x = w[1:] ^ w[:-1]
        equal = np.full(len(x), 8, dtype=np.int64)
        for j in range(8):
            equal = np.where(x >> U64(56 - 8 * j) != 0, np.minimum(equal, j), equal)
        lcp[1:] += np.where(same, equal, 0)
        same &= x == 0
    lcp[1:] = np.minimum(lcp[1:], np.minimum(length[1:], length[:-1]))
    found, listed = scan(lcp.tolist(), owner[at].tolist(), left.tolist(), groups)
    found = np.array(found, dtype=np.int64)
    return (at, found, [(n, at[a:b]) for n, a, b in listed]) if groups else (at, found)


def scan(lcp: list[int], owner: list[int], left: list[int], groups: bool = False) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Walk the tree of common-prefix intervals with a stack.

    A frame is [length, first suffix, least owner, suffixes of that owner, byte before all of them or -1]. When a
    smaller owner joins an interval, or is in it already, suffixes of larger ones have found their longest repeat. An
    interval with one byte before all its suffixes is no maximal repeat, but lies in one that starts further left.
    """
    n, longest, listed, stack = len(lcp), [0] * len(lcp), [], []
    for i in range(1, n + 1):
        reach = lcp[i] if i < n else 0
        child = [0, i - 1, owner[i - 1], [i - 1], left[i - 1]]
        while stack and stack[-1][0] > reach:
            frame = stack.pop()
            _join(frame, child, longest)
            if groups and frame[4] < 0:
                listed.append((frame[0], frame[1], i))
            child = frame
        if reach >= LENGTH:
            if stack and stack[-1][0] == reach:
                _join(stack[-1], child, longest)
            else:
                stack.append([reach, *child[1:]])
    return longest, listed


def _join(frame: list, child: list, longest: list[int]) -> None:
    """Put a closed interval or a suffix into an open interval, and settle the suffixes of the larger owner."""
    length, _, least, mine, byte = frame
    if byte != child[4]:
        frame[4] = -1
    if child[2] == least:
        mine += child[3]
        return
    settled = child[3] if child[2] > least else mine
    for k in settled:
        if not longest[k]:
            longest[k] = length
    if settled is mine:
        frame[2], frame[3] = child[2], child[3]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: spans that repeat a smaller document's, by row. A key's segments are handled together."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        data, offsets = column_bytes(rows.column("segment"))
        ids, row = rows.column("id").to_numpy(), rows.column("row").to_numpy()
        lists = rows.column("starts").combine_chunks()
        starts, place = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        at, length = repeats(data, offsets, ids)
        at, length = at[length > 0], length[length > 0]
        seg = np.searchsorted(offsets, at, "right") - 1
        many = place[seg + 1] - place[seg]
        ends = np.cumsum(many)
        which = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(place[seg], many)
        first = starts[which].astype(np.int64) + np.repeat(at - offsets[seg], many)
        own, blobs = by_row(np.repeat(row[seg], many), first, first + np.repeat(length, many))
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), blobs], ["row", "spans"])

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        known = pc.is_valid(batch.column("spans"))
        yield pa.RecordBatch.from_arrays([c.filter(known) for c in (batch.column("row"), batch.column("spans"))], ["row", "spans"])
        now = pa.Table.from_batches([batch]).filter(pc.invert(known))
        if not now.num_rows:
            continue
        held.append(now)
        size += now.column("segment").nbytes
        if size > SEGMENT_BYTES:
            whole = pa.concat_tables(held)
            key = whole.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield spans(whole.slice(0, cut))
                rest = pa.table({c: pa.chunked_array([whole.slice(cut).column(c).combine_chunks()]) for c in whole.column_names})
                held, size = [rest], rest.column("segment").nbytes
            else:
                held = [whole]
    if held:
        yield spans(pa.concat_tables(held))


class Blocks:
    """Spans by row, as files in the shared folder, one for each block of rows: texts stay where they are, their spans
    are mapped beside them."""

    def __init__(self, root: str) -> None:
        self.root, self.size = root, BLOCK
        self.present: set[int] = set()

    def written(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, all of a block in one task. A block's spans are held joined."""
        held: list[tuple] = []

        def write() -> pa.RecordBatch:
            rows, starts, ends = joined(*(np.concatenate(x) for x in zip(*held)))
            block = int(rows[0]) // self.size
            put(f"{self.root}/{block}", np.stack([rows % self.size, starts, ends]).astype("<u4"))
            return pa.RecordBatch.from_arrays([pa.array([block])], ["block"])

        for batch in batches:
            rows, starts, ends = unpacked(batch.column("row").to_numpy(), batch.column("spans"))
            cuts = np.flatnonzero(np.diff(rows // self.size)) + 1
            for part in zip(*(np.split(x, cuts) for x in (rows, starts, ends))):
                if not len(part[0]):
                    continue
                if held and held[0][0][0] // self.size != part[0][0] // self.size:
                    yield write()
                    held.clear()
                held.append(part)
        if held:
            yield write()

    def build(self, spans: DataFrame, parts: int) -> Blocks:
        dealt = spans.repartition(parts, F.expr(f"row div {self.size}")).sortWithinPartitions("row")
        self.present = {r["block"] for r in dealt.mapInArrow(tidy(self.written), "block long").collect()}
        return self

    def of(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and ends of each row's spans, in a task."""
        blocks, own = rows // self.size, (rows % self.size).astype("<u4")
        files = {k: np.asarray(mapped(f"{self.root}/{k}", "<u4")).reshape(3, -1) for k in np.unique(blocks).tolist() if k in self.present}
        none = np.zeros((3, 0), dtype="<u4")
        for block, row in zip(blocks.tolist(), own):
            held, starts, ends = files.get(block, none)
            at = slice(*np.searchsorted(held, np.array([row, row + 1], dtype="<u4")))
            yield starts[at].astype(np.int64), ends[at].astype(np.int64)


def _removed(blocks: Blocks, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [])
            for text, (starts, ends) in zip(batch.column("text").to_pylist(), blocks.of(batch.column("row").to_numpy())):
                left, at = [], 0
                for s, e in zip(starts.tolist(), ends.tolist()):
                    left.append(text[at:s])
                    at = e
                left = b"".join([*left, text[at:]])
                for held, x in zip(out, (len(text), int((ends - starts).sum()), len(starts), hashlib.sha256(left).hexdigest(), left)):
                    held.append(x)
            columns = [batch.column("id"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(out[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(df: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row for each row of df: (doc_id, n_bytes, n_removed, n_spans, kept_sha256), and the kept bytes on request.

    Texts are UTF-8 bytes, null counts as empty. A byte is removed if a string of LENGTH bytes that covers it in its
    document also starts in a document with a smaller id; overlaps count, and strings are judged on the input. Rows of
    equal ids don't remove each other's bytes; a null id counts as the largest long. Other columns are not read.
    An empty table gives an empty result.
    """
    spark, parts = work.spark, per_gb_partitions(work.spark)
    # numbers are written, so that a row's is the same whenever the table is read; a null id stands behind all others
    given = work.numbered(df.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text")), "row")
    rows = given.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "row", "text")
    bits = max(5, (2 * parts).bit_length())
    blocks = rows.select("id", "text").mapInArrow(tidy(_gathered(bits)), "block long, blob binary")
    shared = work.save(blocks.groupBy("block").applyInPandas(_shared, "block long, n long, blob binary"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    if total <= SHARED:
        keys = [opened(r["blob"], np.uint64)[0] for r in shared.orderBy("block").toLocalIterator()]
        table = spark.sparkContext.broadcast(np.concatenate(keys) if keys else np.zeros(0, np.uint64))
    else:
        table = Filters(work.path("filters"), total).build(shared)
    work.drop("shared")
    work.release()
    segments = rows.mapInArrow(tidy(_segments(table)), SEGMENT_SCHEMA)
    met = segments.repartition(2 * parts, "key").sortWithinPartitions("key")
    spans = work.save(met.mapInArrow(tidy(_found), "row long, spans binary"), "spans")
    work.drop("filters")
    work.release()
    blocks = Blocks(work.path("blocks")).build(spans, parts)
    work.drop("spans")
    work.release()
    told = given.select(F.col("doc_id").alias("id"), "row", "text")
    return told.mapInArrow(tidy(_removed(blocks, keep_text)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


SEGMENT_SCHEMA = "key long, id long, row long, starts array<int>, segment binary, spans binary"
