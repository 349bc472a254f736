"""Every operator against a brute-force version, on the small table and on rows made to be hard."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import embedding_dedup, exact_dedup, jaccard_join, kneser_ney, language_id, mixing, secret_scan, sentence_pieces, suffix_dedup, token_store
from tessera.llm import queries as Q

BLANKS = re.compile(rb"[\x20\x09-\x0D]+")
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(params=["small", "hard"])
def docs(request, small, hard):
    return {"small": small, "hard": hard}[request.param]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(tuple(r) for r in rows)


def lower(b):
    return b.translate(bytes(LOWER))


LOWER = bytearray(range(256))
LOWER[65:91] = range(97, 123)


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


# embeddings


def brute_links(rows, threshold):
    ok = lambda v: v is not None and None not in v and np.isfinite(v).all() and np.any(v)
    links = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        (a, u, x), (b, v, y) = rows[i], rows[j]
        if a is None or b is None or x is None or x != y or not ok(u) or not ok(v) or len(u) != len(v):
            continue
        u, v = np.array(u, float), np.array(v, float)
        if u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= threshold:
            links.append((i, j))
    return links


def check_links(got, rows, threshold):
    links, n = brute_links(rows, threshold), Counter()
    for i, j in links:
        n[i] += 1
        n[j] += 1
    root = roots(len(rows), links)
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    want = [(v, n[i], least.get(root[i]), v == least.get(root[i])) for i, (v, _, _) in enumerate(rows)]
    assert bag(got) == bag(want)


def test_embeddings_table(spark, work):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check_links(embedding_dedup.near_duplicates(df, work).collect(), [(r[0], r[1], r[2]) for r in df.select("vec_id", "embedding", "label").collect()], 0.98)


def test_embeddings_hard(spark, work):
    r = np.random.default_rng(3)
    rows = []
    for c in range(6):
        base = r.standard_normal(16)
        rows += [(base + r.standard_normal(16) * s, c % 3) for s in np.linspace(0, 0.35, 60)]
    base = r.standard_normal(16)
    rows += [(base, 1)] * 40 + [(base * 1e30, 1), (base * 1e-20, 1), (base, None), (base, 2), (base * 2, 2)]
    rows = [(i, [float(x) for x in v], k) for i, (v, k) in enumerate(rows)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] + [0.0] * 14, 1), (903, [float("nan")] * 16, 1), (904, [1.0] * 3, 1), (905, [2.0] * 3, 1), (None, list(map(float, base)), 1), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = embedding_dedup.near_duplicates(df, work)
    check_links([tuple(x) for x in out.collect()], [(a, v, k) for a, v, k in rows], 0.98)
    assert embedding_dedup.near_duplicates(df.limit(0), work).count() == 0


def test_embedding_blocks(spark, work, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(4)
    base = r.standard_normal(8)
    rows = [(i, [float(x) for x in base + r.standard_normal(8) * 0.02 * (1 + i % 5)], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [tuple(x) for x in df.collect()]
    check_links([tuple(x) for x in embedding_dedup.near_duplicates(df, work).collect()], rows, 0.98)


# exact dedup


def test_exact(docs, work):
    rows = pairs(docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANKS.sub(b" ", (t or "").encode())].append(i)
    want = Counter()
    for norm, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        sha, once = hashlib.sha256(norm).hexdigest(), False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            want[(i, first, len(ids), not once and i == first, sha)] += 1
            once |= i == first
    out = exact_dedup.exact_dedup(docs, work).select("id", "keep_id", "group_size", "kept", "text_sha256")
    assert bag(out.collect()) == want
    assert bag(r[:2] for r in exact_dedup.drop_copies(docs, work).select("doc_id", "lang").collect()).total() == len(groups)


def test_quotient_filter_keeps_counts():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 2**64, 3000, dtype=np.uint64) for _ in range(4)]
    parts += [parts[0][:500], np.repeat(parts[1][:3], 1000), np.zeros(5, np.uint64), np.full(2, 2**64 - 1, np.uint64)]
    filters = [exact_dedup.CountingQuotientFilter.from_bytes(exact_dedup.CountingQuotientFilter.of(p).to_bytes()) for p in parts]
    whole = exact_dedup.CountingQuotientFilter.merged(filters)
    values, n = np.unique(np.concatenate(parts), return_counts=True)
    assert (whole.fingerprints() == values).all() and (whole.counts == n).all()


# mixing


def test_mixing(docs, work):
    out = mixing.mix(docs, work).collect()
    rows = docs.collect()
    size = lambda t: len(WORDS.findall((t or "").encode()))
    assert bag((r["doc_id"], r["size"], r["source"]) for r in out) == bag((r["doc_id"], size(r["text"]), r["source"]) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, total = {}, set(order), sum(sizes.values())
    while True:
        share = total - sum(target.values())
        now = {s: share * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if now[s] > 3 * sizes[s]]
        if not over:
            target |= now
            break
        target |= {s: 3 * sizes[s] for s in over}
        left -= set(over)
    taken, largest = Counter(), Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert bag(mixing.mix(docs.repartition(3), work).collect()) == bag(out)
    many = mixing.mixed_rows(docs, work)
    assert many.columns == docs.columns and many.count() == sum(r["copies"] for r in out)


def brute_mix(rows, weights=(5, 2, 1), seed="mix-1"):
    """(doc_id, size, taken) from the description: targets, whole copies, then an order sample by words."""
    docs = [(i, s, len(WORDS.findall((t or "").encode()))) for i, t, s in rows]
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    low, high = 0.0, 3.0 * sum(sizes.values())
    for _ in range(200):
        level = (low + high) / 2
        total = sum(min(level * weights[k % 3], 3 * sizes[s]) for k, s in enumerate(order))
        low, high = (level, high) if total < sum(sizes.values()) else (low, level)
    out = []
    for k, s in enumerate(order):
        own = [(i, n) for i, x, n in docs if x == s]
        target = min(high * weights[k % 3], 3 * sizes[s])
        whole = math.floor(target / sizes[s] + 1e-9) if sizes[s] else 0
        rest = target - whole * sizes[s]
        chance, certain = 0.0, set()
        if rest > 1e-6:
            while True:
                chance = (rest - sum(n for j, (_, n) in enumerate(own) if j in certain)) / sum(n * n for j, (_, n) in enumerate(own) if j not in certain)
                more = {j for j, (_, n) in enumerate(own) if j not in certain and n == max(x for y, (_, x) in enumerate(own) if y not in certain) and chance * n > 1}
                if not more:
                    break
                certain |= more
        queue = []
        for i, n in own:
            u = (int(hashlib.md5(f"{'null' if i is None else i}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = min(max(chance * n, 1e-9), 1 - 1e-9)
            queue.append(((u / (1 - u)) / (p / (1 - p)), n, i is None, i or 0))
        queue = sorted(q for q in queue if q[1] and rest > 1e-6)
        taken, gap = [], rest
        for again in range(2):
            room, kept = gap, []
            stop = False
            for q in queue:
                stop |= q[1] <= room and q[1] > gap + 1e-6 or (not again and q[1] > gap + 1e-6)
                if not stop and q[1] <= gap + 1e-6:
                    taken.append(q)
                    gap -= q[1]
                else:
                    kept.append(q)
            queue = kept
        near = min(queue, key=lambda q: (abs(gap - q[1]), q), default=None)
        if near and abs(gap - near[1]) < gap:
            taken.append(near)
        extra = Counter((None if none else i, n) for _, n, none, i in taken)
        for i, n in own:
            one = extra[(i, n)] > 0
            extra[(i, n)] -= one
            out.append((i, n, (whole + one) * n))
    return Counter(out)


def test_mixing_by_odds(docs, work):
    got = mixing.mix(docs, work).collect()
    assert bag((r["doc_id"], r["size"], r["taken"]) for r in got) == brute_mix([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])


def test_mixing_of_equal_rows(spark, work):
    rows = [(9, "w " * 40, "a")] * 5 + [(k, "w " * (k % 7 + 1), "b") for k in range(200)] + [(300, None, "c"), (301, " ", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df, work).collect()
    assert bag((r["doc_id"], r["size"], r["taken"]) for r in got) == brute_mix(rows)
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2
    assert mixing.mixed_rows(df, work).filter("source = 'c'").count() == 0


def test_mixing_prefers_long_documents(spark, work):
    rows = [(k, "w " * (1 + 9 * (k % 2)), "ab"[k >= 400]) for k in range(800)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), work).collect()
    share = lambda n: sum(r["copies"] for r in got if r["source"] == "b" and r["size"] == n) / 200
    # a document of ten words has ten times the chance of one of a word
    assert share(10) > 4 * share(1) > 0


def same_as_sql(spark, name, sf):
    got = Q.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(Q.ORACLES[name])
    assert sorted(got.columns) == sorted(rel.columns)
    digits = lambda x: round(x, 6) if isinstance(x, float) else x
    key = lambda cols, rows: Counter(tuple(digits(v) for _, v in sorted(zip(cols, r))) for r in rows)
    assert key(got.columns, got.collect()) == key(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, name):
    same_as_sql(spark, name, "/root/testdata/sf0.001")


# token store


def test_token_store(docs, work):
    tokenizer = token_store.Encoder.of(Q.BYTE_BPE).tokenizer
    rows = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in pairs(docs)]
    root = token_store.write_store(docs, work, Q.BYTE_BPE)
    got = token_store.read_store(work, root).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert bag((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == bag((i, len(x), crc(x)) for i, x in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert bag((r["doc_id"], tuple(r["ids"])) for r in token_store.read_ids(work, root).collect()) == bag((i, tuple(x)) for i, x in rows)


def test_encoder_splits_are_safe():
    e = token_store.Encoder.of(Q.BYTE_BPE)
    texts = ["a  b", " a", "a ", "a\n b", "a\n\n  b \n", "a   b", "x\x1c y\x85 z 　 é", "it's  'll <|endoftext|> x", "a\x00 b\x00", "1 2  3 ½ ², ,, .. '", "é è ́ x", "\t\ta b\r\n c"]
    for a, b in itertools.product(texts, texts):
        assert e.encode(a + b).tolist() == e.tokenizer.encode(a + b, add_special_tokens=False).ids


def test_store_of_words_alike(spark, work):
    tokenizer = token_store.Encoder.of(Q.BYTE_BPE).tokenizer
    x, y = ("xxxxxxxx" + t + "yyyyyyyy" for t in thue_morse())
    texts = [f"a {x} b", f"a {y} b", f"{y} {x}", "sixteen_letters_ sixteen_letters_ sixteen_letters", "a\0 a a\0\0 a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = Counter((i, tuple(tokenizer.encode(t, add_special_tokens=False).ids + [0])) for i, t in enumerate(texts))
    assert bag((r["doc_id"], tuple(r["ids"])) for r in token_store.read_ids(work, token_store.write_store(df, work, Q.BYTE_BPE)).collect()) == want


def test_encoder_table_grows(monkeypatch):
    monkeypatch.setattr(token_store.Words, "SLOTS", 1024)
    e = token_store.Encoder(Q.BYTE_BPE)
    for n in (2000, 5000):
        text = " ".join(f"w{k * 7919 % 100003}" + "x" * (k % 30) for k in range(n))
        assert e.encode(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(e.words.slots) >= 2 * len(e.words)


def test_wide_ids(spark, work, tmp_path):
    import json

    spec = json.load(open(Q.BYTE_BPE, encoding="utf-8"))
    vocab = spec["model"]["vocab"]
    vocab |= {f"unused piece {k}": k for k in range(max(vocab.values()) + 1, 70_000)}
    (tmp_path / "wide.json").write_text(json.dumps(spec))
    path = str(tmp_path / "wide.json")
    df = spark.createDataFrame([(0, "one two"), (1, None)], "doc_id long, text string")
    root = token_store.write_store(df, work, path)
    assert spark.read.parquet(f"{root}/manifest").first()["itemsize"] == 4
    ids = token_store.Encoder(path).tokenizer.encode("one two").ids
    assert bag((r["doc_id"], tuple(r["ids"])) for r in token_store.read_ids(work, root).collect()) == Counter([(0, (*ids, 0)), (1, (0,))])


def test_manifest_is_checked(spark, work, small):
    root = token_store.write_store(small, work, Q.BYTE_BPE)
    manifest = spark.read.parquet(f"{root}/manifest")
    rows = manifest.collect()
    assert sum(r["docs"] for r in rows) == small.count() and token_store.read_store(work, root).count() == small.count()
    for change in ("tokens + 1", "docs - 1"):
        name = change.split()[0]
        spark.createDataFrame(rows, manifest.schema).selectExpr(*[change + " AS " + name if c == name else c for c in manifest.columns]).write.mode("overwrite").parquet(f"{root}/manifest")
        with pytest.raises(ValueError):
            token_store.read_store(work, root)
    spark.createDataFrame(rows[1:], manifest.schema).write.mode("overwrite").parquet(f"{root}/manifest")
    with pytest.raises(ValueError):
        token_store.read_store(work, root)


def test_crc_of_parts():
    r = np.random.default_rng(0)
    for n, m in ((0, 0), (1, 0), (0, 5), (3, 4), (1000, 70001)):
        a, b = r.bytes(n), r.bytes(m)
        got = token_store.crc_after(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([m]))
        assert got[0] == zlib.crc32(a + b)


def test_chunks_follow_content():
    ids = np.random.default_rng(5).integers(0, 50000, 60000).astype(np.uint16)
    assert token_store.cuts(ids)[-1] == len(ids) and np.diff(token_store.cuts(ids)).max() <= token_store.MOST
    a = set(token_store.cuts(ids).tolist())
    b = {c - 777 for c in token_store.cuts(np.concatenate([ids[-777:], ids])).tolist()}
    assert len(a & b) > 0.8 * len(a)


# suffix dedup


def brute_repeats(rows):
    least = {}
    last = suffix_dedup.LAST
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, last), last if i is None else i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < (last if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        out[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())] += 1
    return out


def test_suffix(docs, work):
    assert bag(suffix_dedup.remove_repeats(docs, work).collect()) == brute_repeats(pairs(docs))


def test_suffix_without_broadcast(docs, work, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARED", -1)
    assert bag(suffix_dedup.remove_repeats(docs, work).collect()) == brute_repeats(pairs(docs))


def test_suffix_without_broadcast_sends_little(spark, work, monkeypatch):
    # segments of minimisers that one document has must not be shuffled, however many minimisers are shared
    monkeypatch.setattr(suffix_dedup, "SHARED", -1)
    monkeypatch.setattr(suffix_dedup, "SLICE", 40)
    r = np.random.default_rng(9)
    text = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()
    shared = [text(100) for _ in range(30)]
    rows = [(k, text(2000) + shared[k % 30] + text(2000)) for k in range(90)]
    sent, segments = spark.sparkContext.accumulator(0), suffix_dedup._segments

    def counted(known):
        def run(batches):
            for batch in segments(known)(batches):
                sent.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(suffix_dedup, "_segments", counted)
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), work).collect()
    assert bag(found) == brute_repeats(rows)
    every = sum(len(suffix_dedup.window_runs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]) for _, t in rows)
    assert 0 < sent.value < every / 4


def test_suffix_moves_no_text(spark, docs, work, monkeypatch):
    # the result takes spans from files beside the texts, whatever the size of their blocks, and finished shuffles are gone
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3, raising=False)
    out = suffix_dedup.remove_repeats(docs, work)
    assert not re.search("Exchange|Join", out._jdf.queryExecution().executedPlan().toString())
    assert bag(out.collect()) == brute_repeats(pairs(docs))


def test_release_frees_the_last_shuffle(spark, work):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    ids = lambda: {k for k in range(4000) if held.contains(k)}
    before = ids()
    work.save(spark.range(1000).selectExpr("id % 7 AS k").repartition(3, "k"), "dealt")
    made = ids() - before
    work.release()
    for _ in range(50):
        if not made & ids():
            break
        time.sleep(0.1)
    assert made and not made & ids()


def test_suffix_of_hashes_alike(spark, work, monkeypatch):
    # every hash of equal length is the same: what is told by hashes alone would now be wrong
    monkeypatch.setattr(suffix_dedup, "rolling_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) * 0 + np.uint64(7))
    r = np.random.default_rng(8)
    text = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()
    shared = [text(80) for _ in range(4)]
    rows = [(k, text(60) + shared[k % 4] + text(40)) for k in range(24)] + [(30, shared[0] * 2), (None, shared[1]), (2**63 - 1, shared[2])]
    held = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    batches = [pa.RecordBatch.from_pydict({"id": [suffix_dedup.LAST if i is None else i for i, _ in rows], "row": list(range(len(rows))), "text": [t.encode() for _, t in rows]})]
    known = [x for b in suffix_dedup._segments(None)(iter(batches)) for x in b.to_pylist() if x["spans"]]
    where = {k: t.encode() for k, (_, t) in enumerate(rows)}
    for x in known:
        for a, b in zip(*suffix_dedup.unpack([x["spans"]])):
            assert any(where[x["row"]][a:b] in t for k, t in where.items() if k != x["row"])
    assert bag(suffix_dedup.remove_repeats(held, work).collect()) == brute_repeats(rows)


def test_maximal_repeats():
    r = np.random.default_rng(2)
    a, b = (bytes(r.integers(97, 123, 70, dtype=np.uint8)) for _ in range(2))
    parts = [b"x" + a + b"y", b"z" + a[:60] + b"q", b"w" + a[:60] + b"r", b, b]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts])
    at, longest, groups = suffix_dedup.repeats(data, offsets, np.array([3, 1, 2, 4, 5]), groups=True)
    texts = {bytes(data[p[0] : p[0] + n]): sorted(p.tolist()) for n, p in groups}
    whole = b"".join(parts)
    for text, places in texts.items():
        assert places == [m.start() for m in re.finditer(b"(?=" + text + b")", whole)]
    assert a[:60] in texts and b in texts and len(texts[a[:60]]) == 3


# language ID


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"])
    p = np.random.default_rng(0).random((len(pieces.pieces) + 1, 2))
    place = {x: k for k, x in enumerate(pieces.pieces)}

    def brute(text):
        if not text:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(text) + 1):
            k = place.get(text[:n], pieces.unknown if n == 1 else None)
            if k is not None:
                out = out + p[k] * brute(text[n:])
        return out

    for word in ("a", "b", "ab", "abab", "aczb", "babab"):
        assert np.allclose(pieces.forward([word], p)[0], np.log(brute("▁" + word)))
        assert np.allclose(pieces.long_word(word, p), np.log(brute("▁" + word)))
    total = np.zeros_like(p)
    pieces.expected(["abab"], np.array([[3.0, 0.0]]), p, total)
    # every segmentation covers five characters
    assert sum(total[k, 0] * len(x) for k, x in enumerate(pieces.pieces)) + total[-1, 0] == pytest.approx(15)


def test_pieces_of_every_length():
    found = language_id.read_pieces(Q.PIECES)
    assert len(found) == 23960 and max(map(len, found)) == 16
    pieces = language_id.Pieces(found)
    p = np.full((len(found) + 1, 2), 1e-9)
    whole = [x for x in found if len(x) > 8 and x[0] == "▁"]
    assert len(whole) > 1000
    for x in whole[::100]:
        p[found.index(x)] = 0.5
        assert np.allclose(pieces.forward([x[1:]], p), math.log(0.5)) and np.allclose(pieces.long_word(x[1:], p), math.log(0.5))
        total = np.zeros_like(p)
        pieces.expected([x[1:]], np.ones((1, 2)), p, total)
        assert np.allclose(total[found.index(x)], 1)
        p[found.index(x)] = 1e-9


@pytest.mark.parametrize("n", [*range(30, 50), 5000])
def test_long_words_of_unseen_letters(n):
    pieces = language_id.Pieces(["▁", "a", "b", "ab"])
    p = np.full((len(pieces.pieces) + 1, 3), language_id.FLOOR)
    p[-1, 1] *= 2
    want = (n + 1) * math.log(language_id.FLOOR) + np.array([0, n * math.log(2), 0])
    assert np.allclose(pieces.forward(["z" * n], p)[0], want) and np.allclose(pieces.long_word("z" * n, p), want)
    total = np.zeros_like(p)
    pieces.expected(["z" * n], np.array([[3.0, 2.0, 0.0]]), p, total)
    assert np.allclose(total[-1], [3 * n, 2 * n, 0])
    mixed = "zab" * (n // 3)
    assert np.allclose(pieces.forward([mixed], p)[0], pieces.long_word(mixed, p))
    total[:] = 0
    pieces.expected([mixed], np.array([[1.0, 1.0, 1.0]]), p, total)
    assert np.allclose(sum(total[k] * len(x) for k, x in enumerate(pieces.pieces)) + total[-1], len(mixed) + 1)


def test_long_words_teach():
    words = ["".join("abcdefgh"[(k * k + n) % 8] for k in range(n)) for n in (5, 40, 41, 300)]
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "y", "x", "y"], "text": words})
    pieces = language_id.Pieces.of(Q.PIECES)
    got = next(language_id._learned(Q.PIECES, ["x", "y"], None)(iter([batch]))).to_pylist()
    size = lambda k: len((pieces.pieces + ["?"])[k])
    assert [sum(r["n"] * size(r["piece"]) for r in got if r["lang"] == k) for k in (0, 1)] == pytest.approx([5 + 41 + 2, 40 + 300 + 2])


def test_language_held_out(spark, work):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(df, work, Q.PIECES).join(df.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    told = [r for r in got if r["lang_pred"] != "und"]
    assert len(got) > 150 and sum(r["lang"] == r["lang_pred"] for r in told) / len(got) > 0.95


def test_rare_language_is_learned(spark, work, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 30)
    rows = [(k, ["the house and the garden", "das haus und der garten", "la maison et le jardin"][k % 3], ["en", "de", "fr"][k % 3]) for k in range(900)]
    rows += [(k, ["το σπίτι και ο κήπος", "дом и большой сад"][k % 2], ["el", "ru"][k % 2]) for k in range(1000, 1020)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), work, Q.PIECES).collect()
    assert bag((r["doc_id"], r["lang_pred"]) for r in got) == bag((i, lang) for i, _, lang in rows) and all(r["score"] > 0.9 for r in got)


def test_language_hard(hard, work):
    got = language_id.identify(hard, work, Q.PIECES).collect()
    assert bag((r["doc_id"], r["held_out"]) for r in got) == bag((i, zlib.crc32(str("null" if i is None else i).encode()) % 5 == 0) for i, _ in pairs(hard))
    assert sum(r["lang_pred"] == "und" for r in got) == sum(not re.search(r"[^\W\d_]", t or "") for _, t in pairs(hard))
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_labels(hard, work):
    from pyspark.sql import functions as F

    got = language_id.identify(hard.withColumn("lang", F.lit(None).cast("string")), work, Q.PIECES).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


# secrets


def test_secrets(docs, work):
    want = Counter()
    for i, t in pairs(docs):
        spans = []
        for k, rule in enumerate(secret_scan.RULES):
            for m in re.compile(rule.pattern, re.ASCII).finditer(t or ""):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    spans.append((m.start(), k, m.end(), rule.kind, rule.base))
        spans.sort()
        text = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in s)
        n = Counter(s[3] for s in spans)
        want[(i, n["assign"], n["access"], n["hex"], hashlib.sha256(text([s for s in spans if s[4]]).encode()).hexdigest(), text(spans))] += 1
    assert bag(secret_scan.scan_secrets(docs, work).collect()) == want


def test_trigram_queries_admit_every_match():
    q = secret_scan.trigram_query
    assert q("AKIA[A-Z]+") == ("and", frozenset({"aki", "kia"})) and q("[0-9a-f]+") is None and q("ab") is None
    assert q("(abc|xyz)") == ("or", frozenset({"abc", "xyz"})) and q("(abc)?x") is None and q("a.bc") is None
    assert q("abc.*def") == ("and", frozenset({"abc", "def"}))


# Jaccard join


def sets_of(text, width):
    w = WORDS.findall(lower((text or "").encode()))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_jaccard(rows, width, percent):
    sets = [sets_of(t, width) for _, t in rows]
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    root = roots(len(rows), links)
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return Counter((i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, root))


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_jaccard(docs, work, width, percent):
    out = jaccard_join.jaccard_components(docs, work, width, percent).select("doc_id", "n_shingles", "component_id")
    assert bag(out.collect()) == brute_jaccard(pairs(docs), width, percent)


def test_jaccard_small_and_shared(spark, work):
    import random

    r = random.Random(11)
    w = [f"w{k}" for k in range(60)]
    rows = []
    for g in range(12):
        base = [r.choice(w) for _ in range(r.randint(8, 24))]
        for _ in range(25):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice([[], [r.choice(w)], [t[k], r.choice(w)]])
            rows.append((len(rows), " ".join(t)))
    long = [r.choice(w) for _ in range(300)]
    for _ in range(60):
        t = list(long)
        for _ in range(r.randint(0, 14)):
            t[r.randrange(300)] = r.choice(w)
        rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = jaccard_join.jaccard_components(df, work, 2, 80).select("doc_id", "n_shingles", "component_id")
    assert bag(out.collect()) == brute_jaccard(rows, 2, 80)


def thue_morse():
    """Two different words of 2048 letters with one polynomial hash modulo 2**64, whatever its odd base."""
    bits = [bin(k).count("1") & 1 for k in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ab"[1 - b] for b in bits)


def test_jaccard_of_words_alike(spark, work):
    x, y = ("xxxxxxxx" + t + "yyyyyyyy" for t in thue_morse())
    rows = [(0, f"p q {x} r"), (1, f"p q {y} r"), (2, f"P Q {x} R"), (3, x), (4, y)]
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), work).select("doc_id", "n_shingles", "component_id")
    assert bag(out.collect()) == brute_jaccard(rows, 4, 85) and bag(out.select("component_id").collect()) == Counter({(0,): 2, (1,): 1, (3,): 1, (4,): 1})


def shared_rows(r, n=140):
    """Chains of near copies around a few texts, beside others that share a passage with them."""
    w, rows = [f"w{k}" for k in range(500)], []
    bases = [[r.choice(w) for _ in range(60)] for _ in range(3)]
    for k in range(n):
        t = list(bases[k % 3])
        for _ in range(k // 10):
            t[r.randrange(60)] = r.choice(w)
        rows.append((k, " ".join(t + bases[0][:20] * (k % 2))))
    return rows


@pytest.mark.parametrize("split, nearest, few", [(8, (1, 2, None), 0), (4096, (1, None), 1 << 20), (16, (4, None), 0)])
def test_jaccard_blocks_and_steps(spark, work, monkeypatch, split, nearest, few):
    import random

    from tessera.llm import _components

    monkeypatch.setattr(jaccard_join, "SPLIT", split)
    monkeypatch.setattr(jaccard_join, "NEAREST", nearest)
    monkeypatch.setattr(jaccard_join, "TOGETHER", 10)
    monkeypatch.setattr(_components, "FEW", few)
    rows = shared_rows(random.Random(split))
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), work, 2, 80).select("doc_id", "n_shingles", "component_id")
    assert bag(out.collect()) == brute_jaccard(rows, 2, 80)


def test_jaccard_steps_read_what_is_left(spark, work, monkeypatch):
    import random

    from tessera.llm._work import Workspace

    r, read, save = random.Random(3), [], Workspace.save
    rows = shared_rows(r)
    for g in range(30):
        # documents that share half of their words are in lists of three, but never linked: one step is enough for them
        half = [f"t{g}h{k}" for k in range(30)]
        rows += [(len(rows) + d, " ".join(half + [f"t{g}d{d}w{k}" for k in range(30)])) for d in range(3)]

    def watched(self, df, name, **options):
        out = save(self, df, name, **options)
        if name in ("step-0-lists", "step-1-lists"):
            read.append({x["node"] for x in out.select("node").collect()})
        return out

    monkeypatch.setattr(Workspace, "save", watched)
    monkeypatch.setattr(jaccard_join, "NEAREST", (1, None))
    df = spark.createDataFrame([(i, i, t) for i, t in rows], "row long, doc_id long, text string").repartition(4)
    out = jaccard_join.jaccard_components(df, work, 2, 80, row_col="row").select("doc_id", "n_shingles", "component_id")
    assert bag(out.collect()) == brute_jaccard(rows, 2, 80)
    assert len(read) == 2 and max(read[0]) >= 140 and read[1] and max(read[1]) < 140


def test_finished_stages_leave_two_tables(small, work):
    import os

    def left(w):
        return sorted(os.listdir(w.root.removeprefix("file://")))

    from tessera.llm._work import Workspace

    spark = work.spark
    exact, near, mix = (Workspace(spark, x) for x in ("exact", "near", "mix"))
    kept = exact_dedup.drop_copies(small, exact)
    unlike = jaccard_join.drop_near_copies(kept, near, width=5, percent=80)
    mixed = mixing.mixed_rows(unlike, mix, weights=(5, 2, 1), max_repeat=3.0)
    assert mixed.count() > 0 and left(exact) == left(near) == ["dropped", "numbered"] and left(mix) == ["copies", "numbered"]


def test_boundary_follows_cost():
    assert jaccard_join.boundary_by_cost({n: 10 for n in range(1, 25)}, 85, 1e9) == jaccard_join.MOST_SMALL
    assert jaccard_join.boundary_by_cost({8: 100, 9: 100}, 85) == 8
    assert 7 < jaccard_join.boundary_by_cost({n: 10 for n in range(1, 25)}, 85) < 20


# SentencePiece


def unigram_file(path):
    """The public file's pieces as a unigram model: scores like logarithms of probabilities, whose sums are exact."""
    import struct

    size = lambda n: bytes([n & 127 | 128, n >> 7]) if n > 127 else bytes([n])
    block = lambda k, body: bytes([k << 3 | 2]) + size(len(body)) + body
    out = b""
    for k, v in sentence_pieces.fields(open(Q.PIECES, "rb").read()):
        if k == 1:
            f = dict(sentence_pieces.fields(v))
            rank = min(-struct.unpack("<f", f[2])[0], 40_000.0) if 2 in f else 0.0
            score = -round(64 * (2 + math.log(abs(rank) + 2))) / 64
            v = block(1, f[1]) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + (bytes([3 << 3, f[3]]) if 3 in f else b"")
        out += block(k, v)
    path.write_bytes(out + block(2, bytes([3 << 3, 1])))
    return str(path)


@pytest.fixture(params=["merges", "unigram"])
def model_file(request, tmp_path):
    return Q.PIECES if request.param == "merges" else unigram_file(tmp_path / "unigram.model")


def test_pieces_are_the_library_s(docs, work, model_file):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rows = [(i, t or "") for i, t in pairs(docs)]
    want = [(i, tuple(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(t.encode()).hexdigest(), True) for (i, t), ids in zip(rows, library.encode([t for _, t in rows], num_threads=1))]
    got = sentence_pieces.encode(docs, work, model_file, with_ids=True).collect()
    assert bag((r["doc_id"], tuple(r["ids"]), r["ids_crc32"], r["decoded_sha256"], r["same_text"]) for r in got) == bag(want)
    assert all(r["n_pieces"] == len(r["ids"]) for r in got)


def test_pieces_of_odd_words(model_file):
    import random

    import sentencepiece

    library, model, r = sentencepiece.SentencePieceProcessor(model_file=model_file), sentence_pieces.Model(model_file), random.Random(3)
    names = [p for p in model.pieces if len(p) > 1]
    texts = ["".join(r.choice("aeinrst lohE.,1é日😀\x00") for _ in range(r.randint(1, 40))) for _ in range(4000)]
    texts += ["".join(r.choice(names) for _ in range(r.randint(1, 4))).replace(sentence_pieces.MARK, " ") for _ in range(4000)]
    texts += ["a" * n for n in range(60)] + ["=" * n + " " * (n % 7) for n in range(60)] + ["abab" * n for n in range(30)]
    for text, ids in zip(texts, model.encode_batch(texts)):
        assert ids.tolist() == library.encode(text), text


def test_pieces_decode(spark, work):
    texts = ["a  b", "日本 😀\x00", " x ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = sentence_pieces.encode(df, work, Q.PIECES, with_ids=True)
    assert dict(tuple(r) for r in sentence_pieces.decode(coded, work, Q.PIECES).collect()) == {i: t or "" for i, t in enumerate(texts)}


# LM


def brute_kn(rows, folds=5, held=1):
    fold = lambda i: zlib.crc32(str("null" if i is None else i).encode()) % folds
    toks = [WORDS.findall(lower((t or "").encode())) + [None] for _, t in rows]
    train = [t for (i, _), t in zip(rows, toks) if fold(i) != held]
    count = Counter(w for t in train for w in t)
    total, v = sum(count.values()), len(count)
    big = Counter((a, b) for t in train for a, b in zip([b"<s>start"] + t, t))

    def disc(values):
        """k - (k + 1) * Y * n(k+1) / n(k) with Y = n1 / (n1 + 2 * n2), for counts 1, 2, and 3 or more."""
        n = Counter(values)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] or n[2] else 0.5
        told = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2 for k in (1, 2, 3)]
        return [0.0] + [min(max(d, 0.05), k - 0.05) for k, d in enumerate(told, 1)]

    after, ctx, kinds = Counter(b for _, b in big), Counter(), defaultdict(Counter)
    for (a, _), c in big.items():
        ctx[a] += c
        kinds[a][min(c, 3)] += 1
    high, low = disc(big.values()), disc(after.values())
    spare = sum(low[min(c, 3)] for c in after.values()) / len(big) if big else 1.0
    p1 = lambda w: (max(after[w] - low[min(after[w], 3)], 0) / len(big) if big else 0) + spare / (v + 1)

    def p2(a, w):
        if not ctx[a]:
            return p1(w)
        left = sum(high[k] * n for k, n in kinds[a].items()) / ctx[a]
        return max(big[(a, w)] - high[min(big[(a, w)], 3)], 0) / ctx[a] + left * p1(w)

    # probabilities of a context sum to one, with one unknown word
    if big:
        some = next(iter(ctx))
        assert sum(p2(some, w) for w in count) + p2(some, b"<unk>") == pytest.approx(1)
    out = []
    for (i, _), t in zip(rows, toks):
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (v + 1))) for w in t)
        out.append((i, fold(i) == held, len(t), sum(count[w] > 0 for w in t), total, base, sum(math.log10(p2(a, w)) for a, w in zip([b"<s>start"] + t, t))))
    return out


def test_language_model(docs, work):
    got = kneser_ney.score(docs, work, kneser_ney.train(docs, work)).collect()
    want = brute_kn(pairs(docs))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 3))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(a[:5]) == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])
    assert len(got) == len(want)


def test_language_model_of_words_alike(spark, work):
    x, y = thue_morse()
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    ids = [i for i in range(50) if not fold(i)][:3] + [i for i in range(50) if fold(i)][:2]
    rows = list(zip(ids, [f"a {x}", x, "a b", y, f"{x} {y}"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in kneser_ney.score(df, work, kneser_ney.train(df, work)).collect()}
    for a in brute_kn(rows):
        assert tuple(got[a[0]][:5]) == a[:5] and got[a[0]][5] == pytest.approx(a[5]) and got[a[0]][6] == pytest.approx(a[6])
    assert [got[i]["n_known"] for i in ids[3:]] == [1, 2]


def test_words_of_one_code(monkeypatch):
    monkeypatch.setattr(kneser_ney, "codes", lambda hi, lo: hi % np.uint64(3))
    hi, lo = np.array([5, 2, 5, 8, 2, 3, 5], dtype=np.uint64), np.array([1, 1, 2, 1, 1, 9, 1], dtype=np.uint64)
    code, h, low, inverse, order, first = kneser_ney.distinct(hi, lo)
    assert (h[inverse] == hi).all() and (low[inverse] == lo).all() and (code == h % 3).all() and (np.diff(code.astype(int)) >= 0).all()
    assert len(set(zip(h.tolist(), low.tolist()))) == len(h) == 5
    assert dict(zip(zip(h.tolist(), low.tolist()), np.diff(np.append(first, len(order))).tolist())) == Counter(zip(hi.tolist(), lo.tolist()))


def test_counts_as_wide_as_needed():
    from tessera.llm._blocks import narrow, numbers, put

    for most in (0, 255, 256, 1 << 16, 1 << 32, 1 << 40):
        put("file:///tmp/tessera-narrow", narrow(np.array([0, most])))
        assert numbers("file:///tmp/tessera-narrow", 2).tolist() == [0, most]


# empty tables, and nothing that swallows rows


def test_empty(empty, work):
    assert exact_dedup.exact_dedup(empty, work).count() == 0 and exact_dedup.drop_copies(empty, work).count() == 0
    assert mixing.mix(empty, work).count() == 0 and mixing.mixed_rows(empty, work).count() == 0
    assert token_store.read_store(work, token_store.write_store(empty, work, Q.BYTE_BPE)).count() == 0
    assert suffix_dedup.remove_repeats(empty, work).count() == 0
    assert language_id.identify(empty, work, Q.PIECES).count() == 0
    assert secret_scan.scan_secrets(empty, work).count() == 0
    assert jaccard_join.jaccard_components(empty, work).count() == 0 and jaccard_join.drop_near_copies(empty, work).count() == 0
    assert sentence_pieces.encode(empty, work, Q.PIECES).count() == 0
    assert kneser_ney.score(empty, work, kneser_ney.train(empty, work)).count() == 0
