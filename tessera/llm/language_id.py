"""Language ID by segmentation-marginalised unigrams.

The vocabulary is the fixed list of pieces of a public SentencePiece model. For each language every piece has a
probability, learned by expectation maximisation over all segmentations. The probability of a word is the sum over all
its segmentations of the product of their pieces' probabilities, found by the forward algorithm; the words of a text
are independent. Distinct words of one length are handled together as arrays.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U64, claim, fresh, mix, tidy
from ._work import Workspace

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Rounds of learning, and about how many documents they see (taken by a hash of the id).
ROUNDS, SAMPLE = 3, 6000
#: About how many documents of each language they see at least; all of a language that has no more.
PER_LANGUAGE = 1500
#: Weight of the pooled distribution in each language's, and the least probability of a character.
POOL, FLOOR = 200.0, 1e-9
#: Longest word scored by arrays; longer ones go through a scalar pass, which gives the same.
ARRAY_WORD = 40
#: After how many characters sums are scaled: FLOOR to this power is far above what a double can hold.
SCALED = 16
#: Characters of words that are looked up at once.
CELLS = 1 << 18
#: Distinct words whose scores a worker remembers.
REMEMBERED = 300_000
_MULT = U64(0x9E3779B97F4A7C15)


def read_pieces(model_path: str) -> list[str]:
    """Pieces of lower-case letters, with or without the mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    low = {p.lower() for p in found}
    return sorted(p for p in low if p and (p.strip(MARK) == "" and len(p) == 1 or LETTERS.fullmatch(p.removeprefix(MARK))))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of characters."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(codes.shape[1]):
        h = (h + codes[:, k].astype(np.uint64) + U64(1)) * _MULT
    return mix(h)


def _across(inverse: list[np.ndarray], i: int, j: int, rows: np.ndarray):
    """The scaling between two places: the product of the inverse scales after i, up to j."""
    out = 1.0
    for b in range(i // SCALED, j // SCALED):
        out = out * inverse[b][rows]
    return out


class Pieces:
    """The vocabulary as sorted hashes by length, and a piece for each character outside it (the last one)."""

    _loaded: dict[str, Pieces] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        claim("language", cls._loaded.clear)
        if path not in cls._loaded:
            cls._loaded[path] = cls(read_pieces(path))
        return cls._loaded[path]

    def __init__(self, pieces: list[str]) -> None:
        self.pieces, self.unknown, self.longest = pieces, len(pieces), max(map(len, pieces), default=1)
        self.tables = {}
        for n in range(1, self.longest + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            if own:
                h = _hashes(np.array([pieces[i] for i in own], dtype=f"U{n}").view(np.uint32).reshape(len(own), n))
                order = np.argsort(h)
                self.tables[n] = (h[order], np.array(own)[order])

    def spans(self, words: list[str], backwards: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length, with the mark: (from, to, rows, piece) for each span with pieces, by rising `to`."""
        n = len(words[0]) + 1
        codes = np.array([MARK + w for w in words], dtype=f"U{n}").view(np.uint32).reshape(len(words), n).T.astype(np.uint64) + U64(1)
        ends = range(0, n, max(1, CELLS // len(words)))
        for low in reversed(ends) if backwards else ends:
            high = min(n, low + ends.step)
            first, out = max(0, low + 1 - self.longest), []
            h = np.zeros((high - first, len(words)), dtype=np.uint64)
            for size in range(1, min(self.longest, high - first) + 1):
                h = (h[: high - first - size + 1] + codes[first + size - 1 : high]) * _MULT
                hashes, ids = self.tables.get(size, (None, None))
                if hashes is None:
                    continue
                start = max(first, low + 1 - size)
                found = mix(h[start - first :])
                at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                hit = hashes[at] == found
                if size == 1:
                    every = np.arange(len(words))
                    out += [(start + k, start + k + 1, every, piece) for k, piece in enumerate(np.where(hit, ids[at], self.unknown))]
                    continue
                for k in np.flatnonzero(hit.any(axis=1)).tolist():
                    rows = np.flatnonzero(hit[k])
                    out.append((start + k, start + k + size, rows, ids[at[k, rows]]))
            out.sort(key=lambda s: s[1], reverse=backwards)
            yield from out

    def _alpha(self, words: list[str], p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sums over the segmentations up to each place, divided by their value at every SCALED-th, and what 1 over these is."""
        alpha, inverse, at = np.zeros((len(words[0]) + 2, len(words), p.shape[1])), [], 0
        alpha[0] = 1.0

        def scale(j: int) -> None:
            if j and j % SCALED == 0:
                inverse.append(1.0 / np.maximum(alpha[j], 1e-300))
                alpha[j] *= inverse[-1]

        for i, j, rows, piece in self.spans(words):
            if j != at:
                scale(at)
                at = j
            alpha[j, rows] += alpha[i, rows] * p[piece] * _across(inverse, i, j - 1, rows)
        scale(at)
        return alpha, inverse

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability (words, languages) of words of one length; p: (pieces + 1, languages)."""
        alpha, inverse = self._alpha(words, p)
        return np.log(alpha[-1]) - sum(map(np.log, inverse))

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray, total: np.ndarray) -> None:
        """Add to total (pieces + 1, languages) how often each piece is expected in the words; counts: (words, languages)."""
        alpha, inverse = self._alpha(words, p)
        beta, held, n = np.zeros_like(alpha), [], 0
        beta[-1] = counts / np.maximum(alpha[-1], 1e-300)

        def add() -> None:
            piece, got = (np.concatenate(x) for x in zip(*held))
            for k in range(p.shape[1]):
                total[:, k] += np.bincount(piece, got[:, k], minlength=len(total))

        for i, j, rows, piece in self.spans(words, backwards=True):
            step = p[piece] * beta[j, rows] * _across(inverse, i, j, rows)
            beta[i, rows] += step
            held.append((piece, alpha[i, rows] * step))
            n += len(rows)
            if n > CELLS:
                add()
                held, n = [], 0
        if held:
            add()

    def long_word(self, word: str, p: np.ndarray) -> np.ndarray:
        """Log probability by language of a word of any length, scaled at each character."""
        index = {x: i for i, x in enumerate(self.pieces)} if not hasattr(self, "_index") else self._index
        self._index = index
        text, alphas, log = MARK + word, [np.ones(p.shape[1])], np.zeros(p.shape[1])
        for j in range(1, len(text) + 1):
            now = np.zeros(p.shape[1])
            for i in range(max(0, j - self.longest), j):
                k = index.get(text[i:j], self.unknown if j - i == 1 else None)
                if k is not None:
                    now += alphas[i - j] * p[k]
            scale = np.maximum(now, 1e-300)
            log += np.log(scale)
            alphas = [a / scale for a in alphas[-self.longest :]] + [now / scale]
        return log


def by_length(words: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def _remainder(doc_id: int | None, folds: int) -> int:
    """crc32 of the id's decimal text modulo folds; a null id counts as the text "null"."""
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % folds


def _learned(path: str, langs: list[str], p: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, place = Pieces.of(path), {lang: k for k, lang in enumerate(langs)}
        now = np.full((len(pieces.pieces) + 1, len(langs)), 1.0 / (len(pieces.pieces) + 1)) if p is None else p
        total = np.zeros_like(now)
        counts = [Counter() for _ in langs]

        def add() -> None:
            for group in by_length(list(set().union(*counts))).values():
                size = max(1, min(4096, CELLS // len(group[0])))
                for k in range(0, len(group), size):
                    part = group[k : k + size]
                    pieces.expected(part, np.array([[float(c[w]) for c in counts] for w in part]), now, total)
            for c in counts:
                c.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang in place:
                    counts[place[lang]].update(LETTERS.findall((text or "").lower()))
            if sum(map(len, counts)) > 100_000:
                add()
        add()
        at, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(lang.astype(np.int64)), pa.array(total[at, lang])], ["piece", "lang", "n"])

    return run


def learn(df: DataFrame, work: Workspace, model_path: str, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and (pieces + 1, languages) probabilities, from rows outside the held-out fold.

    Of those rows with a language, about SAMPLE are used, but of each language about PER_LANGUAGE at least: those whose
    CRC-32 falls below their language's share of its range.
    """
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary"))
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), crc.alias("crc")).filter(F.col("lang").isNotNull() & (F.col("crc") % folds != 0))
    seen = rows.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in seen)
    size = len(Pieces.of(model_path).pieces) + 1
    if not langs:
        return [], np.zeros((size, 0))
    share = SAMPLE / sum(r["count"] for r in seen)
    below = {r["lang"]: int(min(1.0, max(share, PER_LANGUAGE / r["count"])) * 2**32) for r in seen}
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in below.items() for x in pair]), F.col("lang"))
    sample = work.save(rows.filter(F.col("crc") <= bound).select("text", "lang"), "sample")
    p = None
    for _ in range(ROUNDS):
        got = sample.mapInArrow(tidy(_learned(model_path, langs, p)), "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        n = np.zeros((size, len(langs)))
        n[got["piece"], got["lang"]] = got["n"]
        pooled = n.sum(axis=1, keepdims=True) + 0.01
        pooled /= pooled.sum()
        p = np.maximum((n + POOL * pooled) / (n.sum(axis=0) + POOL), FLOOR)
    return langs, p


def _predicted(path: str, langs: list[str], p: np.ndarray, folds: int, names: list[str], id_at: int | None, text_at: int, out: list[str], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known, scores = Pieces.of(path), {}, np.zeros((0, len(langs)))
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
            new = list(set().union(*map(set, found)).difference(known)) if found else []
            if len(known) > REMEMBERED:
                known, scores = {}, scores[:0]
                new = list(set().union(*map(set, found)))
            held = [scores]
            at = len(known)
            if langs:
                for n, group in by_length(new).items():
                    for k in range(0, len(group), 8192):
                        part = group[k : k + 8192]
                        held.append(pieces.forward(part, p) if n <= ARRAY_WORD else np.array([pieces.long_word(w, p) for w in part]))
                        known.update(zip(part, range(at, at + len(part))))
                        at += len(part)
            scores = np.concatenate(held)
            pred, score = [], []
            for listed in found:
                if not listed or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = scores[np.fromiter(map(known.__getitem__, listed), dtype=np.int64, count=len(listed))].sum(axis=0)
                best = int(total.argmax())
                pred.append(langs[best])
                score.append(float(1.0 / np.exp(np.minimum(total - total[best], 0.0)).sum()))
            more = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if whole:
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, *out])
            else:
                ids = batch.column(id_at)
                held_out = [_remainder(i, folds) == 0 for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held_out, pa.bool_()), *more], ["doc_id", "held_out", *out])

    return run


def identify(df: DataFrame, work: Workspace, model_path: str, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False) -> DataFrame:
    """One row for each row of df: (doc_id, held_out, lang_pred, score), or with keep all of df's columns and the last two.

    score is the posterior of the predicted language under equal priors. A null text, one without a letter, and a
    table without any labelled row give `und` and 0. An empty table gives an empty result. With keep, the new columns
    get underscores at their ends where df has their names.
    """
    langs, p = learn(df, work, model_path, folds, id_col, text_col, lang_col)
    if keep:
        out = [fresh(c, df.columns) for c in ("lang_pred", "score")]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{out[0]} string", f"{out[1]} double"])
        return df.mapInArrow(tidy(_predicted(model_path, langs, p, folds, df.columns, None, df.columns.index(text_col), out, True)), schema)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_predicted(model_path, langs, p, folds, [], 0, 1, ["lang_pred", "score"], False)), "doc_id long, held_out boolean, lang_pred string, score double")
