"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Two sets with 100 * overlap >= PERCENT * union overlap in at least c = ceil(PERCENT * (n + m) / (100 + PERCENT))
shingles, n and m being their sizes. Small sets (both sizes up to the boundary) are joined by their subsets of exactly
c shingles: two sets that share one are candidates. Large sets scan inverted lists. The boundary is the size up to which
listing subsets costs no more than scanning. A set scans only the lists of its rarest n - ceil(PERCENT * n / 100) + 1
shingles, which any partner must share one of, in an order that puts shingles found often last; the order only decides
what is scanned, never what is found.

Equal sets are one set. Lists are joined in steps, so that a list of near copies never gives all its pairs: every member
is first compared with one member of its list. Where members of a list are then still in different components, each
outside the list's largest component meets a few of the other components, the nearest by sketches, more of them in each
step (NEAREST), until sketches leave nobody out. A step only reads lists of members whom the one before left something
to meet: in all others every pair that can be linked has been compared. So what is compared follows the entries, not the pairs of a list. Lists of shingles known to be frequent are dealt in blocks of about
SPLIT entries, and blocks meet in pairs. Candidates pass a bit-sketch bound and are verified by exact overlap of their
64-bit shingle hashes; sets are told apart by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import U64, chunks, claim, fresh, member, mix, pairs_within, shingle_hashes, tidy, word_hashes
from ._components import components
from ._work import BROADCAST_KEYS, Workspace, as_bytes, per_gb_partitions, small_side

#: Most shingles in the table of frequent ones, which is broadcast (16 MB), and the least count to be in it.
FREQUENT, LEAST_FREQUENT = 1 << 20, 8
#: Shingles that a task counts at once.
FLUSH = 1 << 20
#: What an entry of an inverted list costs besides the entries that it meets, as a multiple of a subset; sizes above MOST_SMALL are never small.
SCAN_COST, MOST_SMALL = 3.0, 24
#: Least bits of a sketch, which has as many as its set has shingles or up to twice that.
SKETCH_BITS = 512
#: Entries of a list's block; groups of entries up to which all pairs of a batch's groups are looked at together.
SPLIT, TOGETHER = 4096, 64
#: How many members of other components an entry meets in each step; the last has no bound.
NEAREST = (4, 32, 256, None)


def overlap_needed(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-percent * n // 100) + 1


def subset_sizes(n: int, boundary: int, percent: int) -> list[tuple[int, int, int]]:
    """(smaller, larger, c) of the partner sizes up to the boundary for which a set of size n lists its subsets."""
    out = []
    for m in range(max(1, -(-percent * n // 100)), min(boundary, 100 * n // percent) + 1):
        low, high = min(n, m), max(n, m)
        c = overlap_needed(low, high, percent)
        if c <= low and not (low == high == c):
            out.append((low, high, c))
    return out


def boundary_by_cost(sizes: dict[int, int], percent: int, length: float = 1.0) -> int:
    """The largest size up to which subsets cost no more than scans would, given how many sets have each size and the
    mean length of the lists that entries stand in."""
    best = 0
    for x in range(1, MOST_SMALL + 1):
        listed = sum(k * sum(math.comb(n, c) for _, _, c in subset_sizes(n, x, percent)) for n, k in sizes.items() if n <= x)
        scanned = sum(k * int(prefix_length(np.int64(n), percent)) * (SCAN_COST + length) for n, k in sizes.items() if n <= x)
        if listed > scanned:
            break
        best = x
    return best


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and their rows."""
    h, _, row = word_hashes(data, offsets)
    h, row = shingle_hashes(h, row, width)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def set_keys(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Distinct shingles and their rows as above, and for each row its set's size and 128 bits of it."""
    first, second, words_row = word_hashes(data, offsets)
    h, row = shingle_hashes(first, words_row, width)
    g, _ = shingle_hashes(second, words_row, width)
    order = np.lexsort((h, row))
    h, g, row = h[order], g[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, g, row, rows = h[new], g[new], row[new], len(offsets) - 1
    return h, row, np.bincount(row, minlength=rows), _sums(mix(h), row, rows).view(np.int64), _sums(mix(g), row, rows).view(np.int64)


def _sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    if len(first):
        out[row[first]] = np.add.reduceat(values, first)
    return out


def _surveyed(width: int):
    """A row for each document (size and 128-bit key of its set), and shingles that a task saw in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        held: list[np.ndarray] = []
        size = 0
        names = ["row", "id", "n", "k1", "k2", "sh", "seen"]

        def counted() -> pa.RecordBatch:
            sh, seen = np.unique(np.concatenate(held), return_counts=True)
            sh, seen = sh[seen > 1].view(np.int64), seen[seen > 1]
            none = pa.nulls(len(sh), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 5 + [pa.array(sh), pa.array(seen)], names)

        for batch in batches:
            ids, rows = batch.column("id"), batch.column("row")
            for part, data, offsets in chunks(batch.column("text"), 1 << 20):
                h, row, n, k1, k2 = set_keys(data, offsets, width)
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([rows[part], ids[part], pa.array(n), pa.array(k1), pa.array(k2), none, none], names)
                held.append(h)
                size += len(h)
                if size >= FLUSH:
                    yield counted()
                    held.clear()
                    size = 0
        if held:
            yield counted()

    return run


def _posted(width: int, percent: int, boundary: int, frequent):
    """Lists' entries (list, set, size, place, small: by subset, block of blocks) and a sketch for each set (list null),
    whole and folded to WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        often, rank = frequent.value
        names = ["sh", *ENTRY, "sketch", *WORDS]
        for batch in batches:
            ids = batch.column("row").to_numpy()
            for part, data, offsets in chunks(batch.column("text"), 1 << 20):
                own, k = ids[part], part.stop - part.start
                h, row = distinct_shingles(data, offsets, width)
                n = np.bincount(row, minlength=k)
                bits = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
                base = np.concatenate([[0], np.cumsum(bits)])
                spot = base[row] + (mix(h ^ U64(0x5EED)).view(np.int64) & (bits - 1)[row])
                flips = np.packbits((np.bincount(spot, minlength=base[-1]) & 1).astype(np.uint8), bitorder="little")
                order_key, blocks = h >> U64(1), np.ones(len(h), dtype=np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    order_key = np.where(often[at] == h, U64(1 << 63) | rank[at], order_key)
                    blocks = np.where(often[at] == h, -(-rank[at].astype(np.int64) // SPLIT), 1)
                order = np.lexsort((order_key, row))
                h, row, blocks = h[order], row[order], blocks[order]
                pos = np.arange(len(h)) - (np.cumsum(n) - n)[row]
                take = pos < prefix_length(n, percent)[row]
                m = int(take.sum())
                subset: list[tuple[int, int]] = []
                for i in np.flatnonzero((n > 0) & (n <= boundary)).tolist():
                    first = int(np.searchsorted(row, i))
                    mine = np.sort(h[first : first + n[i]])
                    for low, high, c in subset_sizes(int(n[i]), boundary, percent):
                        salt = U64(low << 32 | high << 16 | c)
                        subset += [(int(mix(np.array([np.add.reduce(mix(mine[list(s)])) ^ salt]))[0]), i) for s in combinations(range(len(mine)), c)]
                sh = np.concatenate([h[take], np.array([s for s, _ in subset], dtype=np.uint64)])
                which = np.concatenate([row[take], np.array([i for _, i in subset], dtype=np.int64)])
                zeros = np.zeros(len(subset), dtype=np.int64)
                place, blocks = np.concatenate([pos[take], zeros]), np.concatenate([blocks[take], zeros + 1])
                block = (mix(own[which].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                small = (np.arange(len(sh)) >= m).astype(np.int64)
                entry = [sh.view(np.int64), own[which], n[which], place, small, block, blocks]
                yield pa.RecordBatch.from_arrays([*map(pa.array, entry), pa.nulls(len(sh), pa.binary()), *[pa.nulls(len(sh), pa.int64())] * len(WORDS)], names)
                raw, folded = flips.tobytes(), np.zeros((0, len(WORDS)), dtype=np.int64)
                if k:
                    folded = np.bitwise_xor.reduceat(flips.view("<i8").reshape(-1, len(WORDS)), base[:-1] // SKETCH_BITS, axis=0)
                blobs = [raw[a:b] for a, b in zip(base // 8, base[1:] // 8)]
                none = pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(own), pa.array(n), *[none] * 4, pa.array(blobs, pa.binary()), *[pa.array(np.ascontiguousarray(w)) for w in folded.T]], names)

    return run


def _starred(percent: int, boundary: int):
    """Of entries sorted by list and block, pairs (node, with) of a block's first entry with each other one that may be
    linked, and the entries themselves (with null) of lists of more than two, of short lists only those that sizes and
    places allow to be linked with another than the first. At most two entries wait for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sh", *ENTRY]
        held = [np.zeros(0, np.int64)] * len(names)
        lead = None

        def found(c: list[np.ndarray], last: bool) -> pa.RecordBatch:
            nonlocal held, lead
            sh, row, n, pos, small, block, blocks = c
            m = len(sh)
            new = np.ones(m, dtype=bool)
            new[1:] = (sh[1:] != sh[:-1]) | (small[1:] != small[:-1]) | (block[1:] != block[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, m))
            group = np.cumsum(new) - 1
            more = lead is not None and (lead[0], lead[4], lead[5]) == (sh[0], small[0], block[0])
            start = [x[first][group] for x in c]
            if more:
                start = [np.where(group == 0, v, x) for v, x in zip(lead, start)]
            big = (size > 2) | (blocks[first] > 1)
            big[0] |= more
            keep = m
            if not last and not big[-1]:
                keep = first[-1]
            held = [x[keep:] for x in c]
            lead = [int(x[-1]) for x in start] if keep == m and not last else None
            fits = _fits(percent, boundary, n, pos, start[2], start[3], small)
            pair = np.flatnonzero(fits[:keep] & (row[:keep] != start[1][:keep]))
            # lists that are whole in this batch, and not cut into blocks
            whole = (size > 2) & (size <= TOGETHER) & (blocks[first] == 1)
            whole[0] &= not more
            whole[-1] &= last
            open_ = ~whole[group]
            some = np.flatnonzero(whole)
            for k in range(0, len(some), 512):
                mine = some[k : k + 512]
                take = np.concatenate([np.arange(first[g] + 1, first[g] + size[g]) for g in mine])
                i, j = (take[x] for x in pairs_within(size[mine] - 1))
                ok = _fits(percent, boundary, n[i], pos[i], n[j], pos[j], small[i])
                open_[i[ok]] = open_[j[ok]] = True
            entry = np.flatnonzero((big[group] & open_)[:keep])
            out = [pa.array(np.concatenate([x[pair], x[entry]])) for x in c]
            with_ = pa.concat_arrays([pa.array(start[1][pair]), pa.nulls(len(entry), pa.int64())])
            return pa.RecordBatch.from_arrays([*out, with_], [*names, "with"])

        for batch in batches:
            if batch.num_rows:
                now = [batch.column(i).cast(pa.int64()).to_numpy() for i in range(len(names))]
                yield found([np.concatenate([h, x]) for h, x in zip(held, now)], False)
        if len(held[0]):
            yield found(held, True)

    return run


def _fits(percent: int, boundary: int, n, pos, m, other_pos, small):
    """Whether the sizes, places and kind of two entries of a list allow a link."""
    need = -(-percent * (n + m) // (100 + percent))
    low, high = np.minimum(n, m), np.maximum(n, m)
    return (100 * low >= percent * high) & (np.minimum(n - pos, m - other_pos) >= need) & ((small == 1) | (high > boundary))


def _still_apart(percent: int, boundary: int, most: int | None):
    """Rows come sorted by group (a list, or two of its blocks): pairs (a, b) of entries in different components that
    sizes, places and sketches allow to be linked, b outside the list's main component, and in how many bits they differ.
    One of them must be open. With most, b meets only so many in the group, the nearest by sketches, and a row (null, b,
    null) tells that there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(c: dict[str, np.ndarray], words: np.ndarray) -> pa.RecordBatch:
            key = np.stack([c[k] for k in GROUP])
            first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            sizes = np.diff(np.append(first, key.shape[1]))
            node, n, pos, part, main = c["node"], c["n"], c["pos"], c["component_id"], c["main"]
            hits: list[tuple[np.ndarray, ...]] = []

            def look(i: np.ndarray, j: np.ndarray) -> None:
                for k in range(0, len(i), 1 << 18):
                    x, y = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                    ok = (part[x] != part[y]) & ((c["open"][x] | c["open"][y]) > 0) & ((c["low"][x] == c["high"][x]) | (c["block"][x] != c["block"][y]))
                    x, y = x[ok], y[ok]
                    ok = _fits(percent, boundary, n[x], pos[x], n[y], pos[y], c["small"][x])
                    x, y = x[ok], y[ok]
                    differ = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
                    ok = differ <= n[x] + n[y] - 2 * -(-percent * (n[x] + n[y]) // (100 + percent))
                    x, y, differ = x[ok], y[ok], differ[ok]
                    out = (part[x] == main[x]) | ((part[y] != main[y]) & (part[x] < part[y]))
                    hits.append((np.where(out, x, y), np.where(out, y, x), differ))

            few = np.flatnonzero((sizes > 1) & (sizes <= TOGETHER))
            for k in range(0, len(few), 512):
                some = few[k : k + 512]
                take = np.concatenate([np.arange(first[g], first[g] + sizes[g]) for g in some])
                i, j = pairs_within(sizes[some])
                look(take[i], take[j])
            for g in np.flatnonzero(sizes > TOGETHER).tolist():
                rows = np.arange(first[g], first[g] + sizes[g])
                own = part[rows] == main[rows]
                inside, outside = rows[own], rows[~own]
                step = max(1, (1 << 18) // len(rows))
                for k in range(0, len(outside), step):
                    b = outside[k : k + step]
                    look(np.repeat(b, len(inside)), np.tile(inside, len(b)))
                    i, j = np.repeat(b, len(outside)), np.tile(outside, len(b))
                    look(i[i < j], j[i < j])
            a, b, differ = (np.concatenate(x) for x in zip(*hits)) if hits else [np.zeros(0, np.int64)] * 3
            more = np.zeros(0, np.int64)
            if most is not None and len(a):
                order = np.lexsort((mix((node[a] ^ node[b]).view(np.uint64)), differ, b))
                a, b, differ = a[order], b[order], differ[order]
                start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                near = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < most
                more = np.unique(node[b[~near]])
                a, b, differ = a[near], b[near], differ[near]
            pairs = np.unique(np.stack([node[a], node[b], differ]), axis=1) if len(a) else np.zeros((3, 0), dtype=np.int64)
            none = pa.nulls(len(more), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x), y]) for x, y in zip(pairs, (none, pa.array(more), none))], ["a", "b", "differ"])

        held: pa.Table | None = None

        def arrays(rows: pa.Table) -> pa.RecordBatch:
            c = {k: rows.column(k).to_numpy().astype(np.int64) for k in rows.column_names if k not in WORDS}
            return found(c, np.stack([rows.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64))

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            same = np.ones(held.num_rows, dtype=bool)
            for k in GROUP:
                x = held.column(k).to_numpy()
                same &= x == x[-1]
            whole = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
            if whole > 4096:
                yield arrays(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield arrays(held)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            for part, data, offsets in chunks(batch.column("text"), 1 << 20):
                h, row = distinct_shingles(data, offsets, width)
                ends = np.searchsorted(row, np.arange(part.stop - part.start + 1)) * 8
                raw = h.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([rows[part], pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["row", "members"])

    return run


def _verified(percent: int):
    """Rows come sorted by centre and salt, the centre's own set first; links are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out = ([], [])
            for c, other, raw in zip(batch.column("centre").to_pylist(), batch.column("other").to_pylist(), batch.column("members").to_pylist()):
                s = np.frombuffer(raw, "<u8")
                if other is None:
                    centre, own = c, s
                elif c == centre:
                    both = int(member(s, own).sum()) if len(s) <= len(own) else int(member(own, s).sum())
                    if 100 * both >= percent * (len(s) + len(own) - both):
                        out[0].append(c)
                        out[1].append(other)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return run


class JaccardJoin:
    def __init__(self, df: DataFrame, work: Workspace, width: int, percent: int, id_col: str, text_col: str, row_col: str | None) -> None:
        self.work, self.width, self.percent = work, width, percent
        if row_col is None:
            # written, so that a row's number is the same whenever the table is read
            row_col = "row"
            df = work.numbered(df.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text")), row_col)
            id_col, text_col = "id", "text"
        self.rows = df.select(F.col(row_col).cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text"))
        self.parts = per_gb_partitions(work.spark)

    def survey(self) -> None:
        work = self.work
        found = work.save(self.rows.mapInArrow(tidy(_surveyed(self.width)), "row long, id long, n long, k1 long, k2 long, sh long, seen long"), "survey")
        self.docs = found.filter("row is not null").select("row", "id", "n", "k1", "k2")
        # a set's node is the row of its smallest id; rows without an id, or without a shingle, are nobody's partner
        nodes = self.docs.filter("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min(F.struct("id", "row")).alias("least"))
        self.nodes = work.save(nodes.select("n", "k1", "k2", F.col("least.id").alias("least_id"), F.col("least.row").alias("node")), "nodes")
        seen = work.save(found.filter("sh is not null").groupBy("sh").agg(F.sum("seen").alias("seen")), "seen")
        left, least, levels = FREQUENT, 64, seen.groupBy(F.floor(F.log2("seen")).alias("level")).agg(F.count("*").alias("k"), F.sum("seen").alias("s"), F.sum(F.col("seen") * F.col("seen")).alias("squares")).collect()
        for r in sorted(levels, key=lambda r: -r["level"]):
            left -= r["k"]
            if left < 0 or 2 ** r["level"] < LEAST_FREQUENT:
                break
            least = r["level"]
        # the mean length of the lists of shingles that aren't put last, an entry of which most prefixes consist
        sizes = {r["n"]: r["k"] for r in self.nodes.filter(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count("*").alias("k")).collect()}
        total = self.docs.agg(F.sum("n")).first()[0] or 1
        rest = [r for r in levels if r["level"] < least]
        self.boundary = boundary_by_cost(sizes, self.percent, 1 + max(0, sum(r["squares"] - r["s"] for r in rest)) / total)
        top = seen.filter(F.floor(F.log2("seen")) >= least).toArrow()
        sh, count = top.column("sh").to_numpy().view(np.uint64), top.column("seen").to_numpy().astype(np.uint64)
        order = np.argsort(sh)
        self.frequent = work.spark.sparkContext.broadcast((sh[order], count[order]))

    def post(self) -> None:
        work = self.work
        mine = self.rows.select("row", "text")
        others = self.docs.select("row").join(self.nodes.select(F.col("node").alias("row")), "row", "left_anti")
        mine = mine.join(small_side(work.save(others, "copies")), "row", "left_anti")
        schema = ", ".join(f"{c} long" for c in ("sh", *ENTRY)) + ", sketch binary, " + ", ".join(f"{w} long" for w in WORDS)
        posted = work.save(mine.mapInArrow(tidy(_posted(self.width, self.percent, self.boundary, self.frequent)), schema), "posted")
        self.sketches = posted.filter("sh is null").select("node", "n", "sketch", *WORDS)
        entries = posted.filter("sh is not null").select("sh", *ENTRY)
        met = entries.repartition(self.parts, "sh", "block").sortWithinPartitions("sh", "small", "block", "node").mapInArrow(tidy(_starred(self.percent, self.boundary)), ", ".join(f"{c} long" for c in ("sh", *ENTRY, "with")))
        met = work.save(met, "met")
        work.release()
        self.pairs = met.filter("with is not null").select(F.col("with").alias("a"), F.col("node").alias("b"))
        self.lists = met.filter("with is null").select("sh", *ENTRY)

    def near(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of candidate pairs of nodes (a, b), those whose sketches allow a link."""
        once = self.work.save(pairs.select("a", "b").distinct(), f"{name}-pairs")
        one, two = (self.sketches.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}s")) for x in "ab")
        both = one.join(small_side(once), "a").join(two.join(small_side(once), "b"), ["a", "b"]).select("a", "b", "an", "bn", "as", "bs")
        apart = F.col("an") + F.col("bn") - 2 * F.ceil(self.percent * (F.col("an") + F.col("bn")) / (100 + self.percent))
        return both.mapInArrow(tidy(_near), "a long, b long, an long, bn long, differ int").filter(F.col("differ") <= apart).select("a", "b")

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of distinct candidate pairs of nodes (a, b), those that are linked."""
        work = self.work
        pairs = work.save(pairs, f"{name}-near")
        few = 2 * pairs.count() <= BROADCAST_KEYS
        # a centre's partners are dealt to as many groups as there are partitions at most; its set goes to each of them
        dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(self.parts)).alias("salt"))
        own = dealt.select("a", "salt").distinct().select(F.col("a").alias("row"), F.col("a").alias("centre"), "salt", F.lit(None).cast("long").alias("other"))
        routes = dealt.select(F.col("b").alias("row"), F.col("a").alias("centre"), "salt", F.col("b").alias("other")).unionByName(own)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("row"))
        texts = self.rows.select("row", "text").join(F.broadcast(wanted) if few else wanted.distinct(), "row", "left_semi")
        sets = texts.mapInArrow(tidy(_sets(self.width)), "row long, members binary")
        sent = sets.join(F.broadcast(routes) if few else routes, "row").select("centre", "salt", "other", "members")
        met = sent.repartition(self.parts, "centre", "salt").sortWithinPartitions("centre", "salt", F.col("other").asc_nulls_first())
        return work.save(met.mapInArrow(tidy(_verified(self.percent)), "a long, b long"), f"{name}-links")

    def join(self) -> DataFrame:
        """(node, component_id) of nodes that have a link."""
        work = self.work
        links, left = self.verify(self.near(self.pairs, "star"), "star"), None
        for step, most in enumerate(NEAREST):
            part_of = components(links, work, f"components-{step}")
            found = work.save(self.apart(part_of, left, most, f"step-{step}").distinct(), f"step-{step}-found")
            pairs, cut = found.filter("a is not null"), found.filter("a is null").select("b")
            more = cut.limit(1).count() > 0
            if more:
                # an entry's lists name much the same members: of all that they name it meets so many
                place = F.row_number().over(Window.partitionBy("b").orderBy("differ", F.xxhash64("a", "b"), "a"))
                placed = pairs.withColumn("place", place)
                pairs = placed.filter(F.col("place") <= most)
                # every pair that is left out now has one of these
                left = work.save(cut.unionByName(placed.filter(F.col("place") > most).select("b")).distinct(), f"step-{step}-left")
            links = links.unionByName(self.verify(self.near(pairs, f"step-{step}"), f"step-{step}"))
            for name in ("mains", "found", "pairs", "near"):
                work.drop(f"step-{step}-{name}")
            work.release()
            if not more:
                break
        return components(links, work, "components").select(F.col("id").alias("node"), "component_id")

    def apart(self, part_of: DataFrame, left: DataFrame | None, most: int | None, name: str) -> DataFrame:
        """Pairs to compare, of entries of lists that hold several components and a node of `left` (b; None: any node),
        which one of a pair must be. Components only grow, so that a list that holds one is done with."""
        work = self.work
        part_of = small_side(part_of.select(F.col("id").alias("node"), "component_id"))
        own = self.lists.join(part_of, "node", "left").withColumn("component_id", F.coalesce("component_id", "node"))
        if left is None:
            own = own.withColumn("open", F.lit(1).cast("long"))
        else:
            again = small_side(left.select(F.col("b").alias("node"))).withColumn("open", F.lit(1).cast("long"))
            own = own.join(again, "node", "left").withColumn("open", F.coalesce("open", F.lit(0).cast("long")))
        parts = own.groupBy("sh", "small", "component_id").agg(F.count("*").alias("k"), F.max("open").alias("open"))
        mains = parts.groupBy("sh", "small").agg(F.max(F.struct("k", "component_id")).alias("m"), F.count("*").alias("parts"), F.max("open").alias("open"))
        mains = mains.filter((F.col("parts") > 1) & (F.col("open") > 0))
        mains = work.save(mains.select("sh", "small", F.col("m.component_id").alias("main")), f"{name}-mains")
        open_ = own.join(small_side(mains), ["sh", "small"])
        self.lists = work.save(open_.select("sh", *ENTRY, "component_id", "main", "open"), f"{name}-lists")
        other = F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block")))
        met = self.lists.withColumn("beside", other).withColumns({"low": F.least("block", "beside"), "high": F.greatest("block", "beside")}).join(self.sketches.select("node", *WORDS), "node")
        self.lists = self.lists.select("sh", *ENTRY)
        met = met.select("sh", "small", "low", "high", "node", "n", "pos", "block", "component_id", "main", "open", *WORDS)
        return met.repartition(self.parts, *GROUP).sortWithinPartitions(*GROUP).mapInArrow(tidy(_still_apart(self.percent, self.boundary, most)), "a long, b long, differ long")


WORDS = [f"w{k}" for k in range(SKETCH_BITS // 64)]
ENTRY = ["node", "n", "pos", "small", "block", "blocks"]
GROUP = ["sh", "small", "low", "high"]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many bits the sketches of a pair differ: no more than their sets do. A longer sketch is folded."""

    def bits(raw: bytes, size: int) -> int:
        x, now = int.from_bytes(raw, "little"), len(raw)
        while now > size:
            now //= 2
            x = (x >> (8 * now)) ^ (x & ((1 << (8 * now)) - 1))
        return x

    for batch in batches:
        a, b = batch.column(batch.schema.names.index("as")).to_pylist(), batch.column(batch.schema.names.index("bs")).to_pylist()
        differ = [(bits(x, size := min(len(x), len(y))) ^ bits(y, size)).bit_count() for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(differ, pa.int32())], ["a", "b", "an", "bn", "differ"])


def jaccard_components(df: DataFrame, work: Workspace, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row for each row of df: (row, doc_id, n_shingles, component_id).

    Words are maximal runs of bytes other than 0x20, 0x09-0x0D, A-Z read as a-z. A set is the distinct runs of `width`
    words; with fewer words the whole sequence is its one member. Sets with 100 * overlap >= percent * union are
    linked; a null or empty text, or one without a word, has an empty set and no link, and so has a row without an id.
    component_id is the smallest id reachable by links, the row's own included. Rows of equal ids are separate rows.
    Other columns are not read. An empty table gives an empty result.
    """
    j = JaccardJoin(df, work, width, percent, id_col, text_col, row_col)
    j.survey()
    j.post()
    linked = j.join()
    nodes = j.nodes.join(linked, "node", "left").withColumn("part", F.coalesce("component_id", "node"))
    least = nodes.groupBy("part").agg(F.min("least_id").alias("least"))
    out = j.docs.join(nodes.join(least, "part").select("n", "k1", "k2", "least"), ["n", "k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("least")).otherwise(F.col("id"))
    return out.select("row", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_copies(df: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one row of each component, that of the smallest id; all columns stay as they are."""
    row, before = fresh("row_number", df.columns), set(work.names)
    keyed = work.numbered(df, row)
    found = jaccard_components(keyed, work, id_col=id_col, text_col=text_col, row_col=row, **options).filter("doc_id is not null")
    found = work.save(found.withColumn("empty", F.when(F.col("n_shingles") == 0, F.col("row"))), "found")
    kept = found.groupBy("component_id", "empty").agg(F.min(F.struct("doc_id", "row")).alias("k")).select(F.col("k.row").alias("row"))
    dropped = work.save(found.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(row)), "dropped")
    work.finish(before, "numbered", "dropped")
    return keyed.join(small_side(dropped), row, "left_anti").select(*df.columns)
