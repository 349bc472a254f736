"""The pipeline's stages, each against what the operators' brute-force versions keep."""

import re
from collections import Counter

import pytest

import corpus_pipeline as P

from test_operators import BLANKS, brute_jaccard, brute_mix


@pytest.fixture(params=["small", "hard"])
def docs(request, small, hard):
    return {"small": small, "hard": hard}[request.param]


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_language(spark, docs):
    out = P.language(spark, docs, "")
    gone = bag(docs) - bag(out)
    assert out.columns == docs.columns and not bag(out) - bag(docs)
    lettered = [r for r in gone.elements() if re.search(r"[^\W\d_]", r[1] or "")]
    assert len(lettered) <= 0.02 * docs.count() + 3 and sum(not re.search(r"[^\W\d_]", r[1] or "") for r in bag(out)) == 0


def test_exact(spark, docs):
    out = P.exact(spark, docs, "")
    norm = lambda t: BLANKS.sub(b" ", (t or "").encode())
    least = {}
    for r in docs.collect():
        k = norm(r["text"])
        least[k] = min(least.get(k, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    assert Counter((norm(r["text"]), (r["doc_id"] is None, r["doc_id"] or 0)) for r in out.collect()) == Counter(least.items())
    assert out.columns == docs.columns


def test_near(spark, docs):
    out = P.near(spark, docs, "")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_jaccard(rows, 5, 80)
    groups = {c for (i, n, c) in want if n and i is not None}
    others = sum(k for (i, n, c), k in want.items() if not n or i is None)
    assert out.count() == len(groups) + others and out.columns == docs.columns


WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def mixed(docs):
    """The rows of the mix from the contract's text, by the operator's own independent brute-force version."""
    rows = docs.collect()
    want = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in rows])
    out = Counter()
    for (i, n, taken), k in want.items():
        if n:
            out[(i, n)] += taken // n * k
    return out


def test_mix(spark, docs):
    out = P.mix(spark, docs, "")
    size = lambda t: len(WORDS.findall((t or "").encode()))
    got = Counter((r["doc_id"], size(r["text"])) for r in out.collect())
    # documents without words take no place in the mix, so how often they come is not told by words taken
    assert Counter({k: n for k, n in got.items() if k[1]}) == Counter({k: n for k, n in mixed(docs).items() if n})
    assert out.columns == docs.columns and not set(bag(out)) - set(bag(docs))


def test_pieces(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.PIECES)
    out = P.pieces(spark, docs, "").collect()
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == want and all(r["same_text"] for r in out)


@pytest.mark.parametrize("name", ["hard", "empty"])
def test_run_on_hard_and_empty_tables(spark, request, tmp_path, name):
    docs = request.getfixturevalue(name)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    out = P.run(spark, f"file://{tmp_path}")
    found = out.collect()
    assert out.columns[:2] == ["doc_id", "n_pieces"] and bool(found) == (name == "hard")
    assert {r["doc_id"] for r in found} <= {r["doc_id"] for r in docs.collect()} and all(r["same_text"] for r in found)


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.filter("not same_text").count() == 0
