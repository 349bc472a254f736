"""Secret scans over a trigram inverted index.

Each rule's pattern is parsed into a Boolean query over the trigrams that every match must hold. A batch of texts is
indexed once: for each trigram that some rule asks for, the texts that hold it. A rule's postings are intersected and
united as its query says, and only the texts that remain are searched with the pattern itself. A rule without
mandatory trigrams scans every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse

from ._bytes import LOWER, chunks
from ._work import Workspace, as_bytes


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of a group (0: the match) for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The base kinds, in their order, then the kinds that this scanner adds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("temporary_access", r"ASIA[A-Z0-9]{16}"),
    Rule("bearer", r"(?i:authorization)\x20*:\x20*(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+"),
)

#: Strings of a part of a pattern that are followed at most, before their trigrams are taken as they stand.
FOLLOWED = 64
ANY = None


def _and(*parts):
    parts = [p for p in parts if p is not ANY]
    flat = frozenset().union(*[p[1] if isinstance(p, tuple) and p[0] == "and" else [p] for p in parts]) if parts else frozenset()
    return ANY if not flat else next(iter(flat)) if len(flat) == 1 else ("and", flat)


def _or(*parts):
    if not parts or any(p is ANY for p in parts):
        return ANY
    flat = frozenset(parts)
    return next(iter(flat)) if len(flat) == 1 else ("or", flat)


def _trigrams(strings: frozenset[str]):
    """What a text must hold that holds one of the strings."""
    return _or(*[_and(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


class _Info:
    """Of a part of a pattern: all strings it matches (None: too many to list), and its query."""

    def __init__(self, exact: frozenset[str] | None, query=ANY) -> None:
        self.exact, self.query = exact, query


def _class(items) -> frozenset[str] | None:
    out = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 12:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 12 and all(len(c) == 1 for c in out) else None


def _analyse(tree) -> _Info:
    """Sequences: strings of neighbours are joined while they can be listed; else their trigrams are kept."""
    query, run = ANY, frozenset([""])
    whole = True
    for op, value in tree:
        if op is sre.LITERAL:
            info = _Info(frozenset([chr(value).lower()]))
        elif op is sre.IN:
            info = _Info(_class(value))
        elif op is sre.SUBPATTERN:
            info = _analyse(value[3])
        elif op is sre.BRANCH:
            parts = [_analyse(x) for x in value[1]]
            listed = frozenset().union(*[p.exact for p in parts]) if all(p.exact is not None for p in parts) else None
            info = _Info(listed if listed is not None and len(listed) <= FOLLOWED else None, _or(*[_and(p.query, _trigrams(p.exact) if p.exact is not None else ANY) for p in parts]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
            low, high, inner = value
            part = _analyse(inner)
            if (low, high) == (0, 1) and part.exact is not None:
                info = _Info(part.exact | {""})
            elif low == high == 1:
                info = part
            elif low:
                info = _Info(None, _and(part.query, _trigrams(part.exact) if part.exact is not None else ANY))
            else:
                info = _Info(None)
        elif op is sre.AT:
            info = _Info(frozenset([""]))
        else:
            info = _Info(None)
        if info.exact is not None and len(run) * len(info.exact) <= FOLLOWED:
            run = frozenset(a + b for a, b in product(run, info.exact))
        else:
            whole = False
            query = _and(query, _trigrams(run), info.query)
            run = info.exact if info.exact is not None else frozenset([""])
    return _Info(run if whole else None, _and(query, ANY if whole else _trigrams(run)))


def trigram_query(pattern: str):
    """Over lower-cased text: a trigram, ("and", queries), ("or", queries), or None where nothing is mandatory."""
    info = _analyse(sre_parse.parse(pattern))
    query = _and(info.query, _trigrams(info.exact) if info.exact is not None else ANY)
    return query


def _leaves(query) -> set[str]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_leaves, query[1]))


class TrigramIndex:
    """Postings of the wanted trigrams in a block of texts; bytes A-Z are read as a-z."""

    def __init__(self, wanted: list[bytes]) -> None:
        self.table = np.full(1 << 24, -1, dtype=np.int16)
        for k, t in enumerate(wanted):
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = k
        self.n = len(wanted)

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if len(data) < 3:
            return [np.zeros(0, dtype=np.int64)] * self.n
        low = LOWER[data].astype(np.int32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        which = self.table[codes]
        at = np.flatnonzero(which >= 0)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique(which[at][inside].astype(np.int64) << 40 | row[inside])
        return np.split(pairs & ((1 << 40) - 1), np.searchsorted(pairs >> 40, np.arange(1, self.n)))


class Scanner:
    _loaded: dict[tuple[Rule, ...], Scanner] = {}

    @classmethod
    def of(cls, rules: tuple[Rule, ...]) -> Scanner:
        if rules not in cls._loaded:
            cls._loaded[rules] = cls(rules)
        return cls._loaded[rules]

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        # a trigram with a character beyond ASCII is left out: the query then only admits more texts
        self.queries = [self._ascii(trigram_query(r.pattern)) for r in rules]
        self.wanted = sorted(set().union(*map(_leaves, self.queries)))
        self.index = TrigramIndex([t.encode() for t in self.wanted])
        self.place = {t: k for k, t in enumerate(self.wanted)}

    def _ascii(self, query):
        if query is ANY or isinstance(query, str):
            return query if query is ANY or query.isascii() and len(query) == 3 else ANY
        return (_and if query[0] == "and" else _or)(*[self._ascii(q) for q in query[1]])

    def candidates(self, query, postings: list[np.ndarray], rows: int) -> np.ndarray:
        if query is ANY:
            return np.arange(rows)
        if isinstance(query, str):
            return postings[self.place[query]]
        lists = sorted((self.candidates(q, postings, rows) for q in query[1]), key=len)
        out = lists[0]
        for more in lists[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, kind's place, end), in order, in code points."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        for rows, data, offsets in chunks(texts):
            postings = self.index.postings(data, offsets)
            decoded: dict[int, str] = {}
            raw = data.tobytes()
            for k, (rule, pattern, query) in enumerate(zip(self.rules, self.patterns, self.queries)):
                for i in self.candidates(query, postings, len(offsets) - 1).tolist():
                    text = decoded.get(i)
                    if text is None:
                        text = decoded[i] = raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
                    for m in pattern.finditer(text):
                        s, e = m.span(rule.group)
                        if e - s >= rule.least:
                            out[rows.start + i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


def _found(rules: tuple[Rule, ...]):
    base = [k for k, r in enumerate(rules) if r.base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(rules)
        for batch in batches:
            found = scanner.scan(batch.column("text"))
            counts = [[sum(s[1] == k for s in spans) for spans in found] for k in base]
            digest = [hashlib.sha256(",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans if rules[k].base).encode()).hexdigest() for spans in found]
            listed = [",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans) for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(listed, pa.string())], ["doc_id", *[f"n_{rules[k].kind}" for k in base], "base_sha256", "spans"])

    return run


def scan_secrets(df: DataFrame, work: Workspace, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: (doc_id, n_<kind> for each base kind, base_sha256, spans).

    Matches are leftmost and do not overlap within a kind; spans are whole matches, start and end in code points. A
    null or empty text has no spans; null ids and repeated rows come through as they are. An empty table gives none.
    """
    base = ", ".join(f"n_{r.kind} long" for r in rules if r.base)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return rows.mapInArrow(_found(rules), f"doc_id long, {base}, base_sha256 string, spans string")
