"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The text is cut at marked words: a run of marks (spaces) with the characters up to the next. No piece of the
vocabulary reaches over such a cut, so words can be segmented alone. The distinct new words of a batch are sorted, which
puts them in the depth-first order of their trie, and the best segmentation of each shared prefix is kept on a stack: a
word continues from the prefix it shares with the word before. A character outside the vocabulary becomes the pieces of
its UTF-8 bytes.

What is best is the library's for the kind of model that the file says it holds. Unigram: the greatest sum of scores,
of equal ones that whose last piece is longest. Merges: the outcome of merging the neighbours of the best score first,
for which a prefix has one last piece only: the one whose neighbour before it, in the outcome of the rest, would not
have merged with it or with a part of it first.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from math import inf
from os.path import commonprefix
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import claim, tidy
from ._work import Workspace, as_bytes

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct words whose ids a worker remembers, and neighbours of which it remembers whether they stay apart.
REMEMBERED, NEIGHBOURS = 450_000, 400_000
# Fixed values of the model file's format: kinds of model.
UNIGRAM, MERGES = 1, 2
#: How far below the least score an unknown character's is.
UNKNOWN = 10.0


def fields(data: bytes):
    """(number, value) of a protocol buffer's fields; groups don't occur in model files."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def kind_of(path: str) -> int:
    """The kind of model that a file says it holds (field 3 of the file's field 2; unigram where it says nothing)."""
    with open(path, "rb") as f:
        trainer = b"".join(v for k, v in fields(f.read()) if k == 2)
    return ([v for k, v in fields(trainer) if k == 3] or [UNIGRAM])[-1]


class Model:
    """The pieces and scores of a model file with an identity normaliser and byte fallback."""

    _loaded: dict[str, Model] = {}

    @classmethod
    def of(cls, path: str) -> Model:
        claim("pieces", cls._loaded.clear)
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {self.names[i]: (model.get_score(i), i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece reaches over the start of a word")
        # all ends of pieces: a string that isn't among them can't be made longer to the left into a piece
        self.ends = {p[k:] for p in self.pieces for k in range(len(p))}
        self.floor = min(s for s, _ in self.pieces.values()) - UNKNOWN
        self.raw = [self.names[i].replace(MARK, " ").encode() for i in range(size)]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        for i in range(size):
            if model.is_control(i):
                self.raw[i] = b""
        self.words: dict[str, bytes] = {}
        self.merging = kind_of(path) == MERGES
        if self.merging:
            self._learn_merges()

    def _learn_merges(self) -> None:
        """Ranks of pieces (characters have none), and how each one's last and first part grow while it is merged."""
        by_score = sorted((p for p in self.pieces if len(p) > 1), key=lambda p: -self.pieces[p][0])
        self.rank = {p: k for k, p in enumerate(by_score)}
        parts = {p: self._last_merge(p) for p in by_score}
        # a piece that merging its own characters doesn't give is never in an outcome
        self.found = {p: i for p, (_, i) in self.pieces.items() if len(p) == 1 or parts[p]}

        def grown(piece: str, side: int) -> list[str]:
            chain = [piece]
            while len(chain[-1]) > 1:
                chain.append(parts[chain[-1]][side])
            return chain[::-1]

        self.tails, self.heads = {p: grown(p, 1) for p in self.found}, {p: grown(p, 0) for p in self.found}
        self.apart: dict[tuple[str, str], bool] = {}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge gives the piece, or None where merging its characters gives something else."""
        now = list(piece)
        while len(now) > 2:
            ranks = [self.rank.get(a + b, inf) for a, b in zip(now, now[1:])]
            k = ranks.index(least := min(ranks))
            if least == inf:
                return None
            now[k : k + 2] = [now[k] + now[k + 1]]
        return (now[0], now[1]) if len(now) == 2 else None

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether a and b, each of which merging gives, are both left when they stand side by side.

        a's last part and b's first one grow in the order of their ranks; they fall together where their own merge comes
        before either grows further (of equal ranks the one further left goes first).
        """
        got = self.apart.get((a, b))
        if got is None:
            rank, tails, heads, i, j = self.rank, self.tails[a], self.heads[b], 0, 0
            while True:
                own = rank.get(tails[i] + heads[j], inf)
                left = rank[tails[i + 1]] if i + 1 < len(tails) else inf
                right = rank[heads[j + 1]] if j + 1 < len(heads) else inf
                if own < left and own <= right:
                    got = False
                    break
                if left == right == inf:
                    got = True
                    break
                if left <= right:
                    i += 1
                else:
                    j += 1
            if len(self.apart) >= NEIGHBOURS:
                self.apart.clear()
            self.apart[a, b] = got
        return got

    def merged(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each distinct word, as the model's merges give them."""
        out: dict[str, bytes] = {}
        # at depth j of the stacks: the last piece of the first j characters (None: an unknown one), and the ids so far
        last, ids = [None], [()]
        before, found, ends, apart = "", self.found, self.ends, self.stay_apart
        for word in sorted(words):
            keep = len(commonprefix((before, word))) + 1
            del last[keep:], ids[keep:]
            for j in range(keep, len(word) + 1):
                i = j
                while i:
                    i -= 1
                    part = word[i:j]
                    which = found.get(part)
                    if which is not None and (not i or last[i] is None or apart(last[i], part)):
                        last.append(part)
                        ids.append((ids[i], which))
                        break
                    if part not in ends:
                        break
                if len(last) == j:
                    if word[j - 1] in found:
                        raise ValueError(f"no outcome of merges for {word[:j]!r}")
                    last.append(None)
                    ids.append((ids[j - 1], -ord(word[j - 1]) - 1))
            before, listed, at = word, [], ids[len(word)]
            while at:
                at, which = at
                if which >= 0:
                    listed.append(which)
                elif self.bytes:
                    listed += [self.bytes[b] for b in reversed(chr(-which - 1).encode())]
                else:
                    listed.append(self.unknown)
            out[word] = pack("<%dI" % len(listed), *listed[::-1])
        return out

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each distinct word, as little-endian unsigned 32-bit integers."""
        if self.merging:
            return self.merged(words)
        out: dict[str, bytes] = {}
        # at depth j of the stacks: the best score of the first j characters, where its last piece starts, and its id
        score, back, piece = [0.0], [0], [-1]
        last, known, ends, floor = "", self.pieces, self.ends, self.floor
        for word in sorted(words):
            keep = len(commonprefix((last, word))) + 1
            del score[keep:], back[keep:], piece[keep:]
            for j in range(keep, len(word) + 1):
                best, at, which, i = -inf, j - 1, -1, j
                while i:
                    i -= 1
                    part = word[i:j]
                    if got := known.get(part):
                        total = score[i] + got[0]
                        if total >= best:
                            best, at, which = total, i, got[1]
                    elif i == j - 1:
                        best = score[i] + floor
                    if part not in ends:
                        break
                score.append(best)
                back.append(at)
                piece.append(which)
            last, ids, j = word, [], len(word)
            while j:
                i = back[j]
                if piece[j] >= 0:
                    ids.append(piece[j])
                elif self.bytes:
                    ids += [self.bytes[b] for b in reversed(word[i:j].encode())]
                else:
                    ids.append(self.unknown)
                j = i
            out[word] = pack("<%dI" % len(ids), *ids[::-1])
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the mark that the model puts before a text that isn't empty."""
        cut = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > REMEMBERED:
            self.words.clear()
        new = set().union(*map(set, cut)).difference(self.words) if cut else set()
        self.words.update(self.segment(list(new)))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, c)), dtype="<u4") for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the mark before it is taken off. Bytes that form no character become U+FFFD."""
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def _coded(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            for k in range(0, len(texts), 256) if texts else ():
                part = texts[k : k + 256]
                ids = model.encode_batch(part)
                back = [model.decode(x) for x in ids]
                columns = [
                    batch.column("doc_id").slice(k, len(part)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    pa.array([a == b for a, b in zip(part, back)], pa.bool_()),
                ]
                names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "same_text"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(df: DataFrame, work: Workspace, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row of df: (doc_id, n_pieces, ids_crc32, decoded_sha256, same_text), and the ids on request.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers; decoded_sha256 over the UTF-8 bytes of the
    text that the ids decode to, and same_text tells whether that is the text itself (a text that holds U+2581 decodes
    with spaces in its place). A null or empty text has no pieces. Null ids and repeated rows come through as they are;
    other columns are not read. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    more = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(tidy(_coded(model_path, with_ids)), f"doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, same_text boolean{more}")


def decode(df: DataFrame, work: Workspace, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of each row's list of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(model_path)
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(tidy(run), "doc_id long, text string")
