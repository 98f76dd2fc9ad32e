"""Byte-level BPE against tiktoken; the token ledger against a recount."""

import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from cases import awkward, frame, in_order, rows_of, sha

from mcid.llm import bpe, tokencounts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_texts(ranks, known):
    e = bpe.Encoder(ranks, PATTERN, most=500)
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "Bc", "é", "1", "23", "!", "…", "日本", "\x0b", "\x1c", "\x85", "'s", "'LL", "\u3000", "\u200b", "👍", "<|endoftext|>", "word" * 40]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(15))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 400, "\n" * 300, " " * 300, ""]
    for t, ids in zip(texts, e.encode_batch(texts)):
        assert ids == known.encode_ordinary(t), repr(t)
        assert e.decode(ids) == t.encode()


def test_spaces_that_cancel_out_in_number(ranks, known):
    e = bpe.Encoder(ranks, PATTERN)
    texts = ["Price: \u00a0 \u00a0 10 EUR\n\nOffer\n\nEnd", "def f():\n    if x:\n        return 1\n\treturn\u00a02"]
    assert len(texts[0].split()) == len(texts[0].split(" "))
    for t, ids in zip(texts, e.encode_batch(texts)):
        assert ids == known.encode_ordinary(t), repr(t)
        assert e.decode(ids) == t.encode()


def test_array_merges_equal_the_tree(ranks):
    r = random.Random(6)
    pieces = [bytes(r.choice(b"abcde etaoin\xc3\xa9") for _ in range(r.randrange(2, 129))) for _ in range(500)]
    pieces = [p for p in pieces if p not in ranks]
    assert bpe.merge_many(pieces, bpe.Pairs(ranks)) == [bpe.merge_piece(p, ranks) for p in pieces]


def test_a_byte_without_an_id_is_an_error():
    with pytest.raises(KeyError):
        bpe.merge_many([b"ab"], bpe.Pairs({b"a": 0}))


def test_digests(docs, empty, known):
    got = rows_of(bpe.digests(docs, PATH, PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, text, *_ in awkward():
        ids = known.encode_ordinary(text or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(text or "")))
    assert got == in_order(want)
    assert bpe.digests(empty, PATH, PATTERN).count() == 0


def test_encode_then_decode(docs):
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    got = in_order([(r.doc_id, bytes(r.bytes).decode()) for r in back.collect()])
    assert got == in_order([(i, t or "") for i, t, *_ in awkward()])


def recount(rows, count, version):
    """Totals of texts without repeated lines, exact copies of smaller ids left out."""
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = Counter()
    for i, t, lang, source, _ in rows:
        if i is not None and i > first[t or ""]:
            continue
        lines = (t or "").split("\n")
        once = "\n".join(dict.fromkeys(lines)) if i is not None else t or ""
        key = (source, lang, version)
        out[key, "docs"] += 1
        out[key, "tokens"] += count(once)
    return in_order([(*k, out[k, "docs"], out[k, "tokens"]) for k in {k for k, _ in out}])


def test_upkeep(spark, empty, known):
    # a repeated id is one document of several rows for the ledger, so ids are single here
    rows = list({r[0]: r for r in awkward() if r[0] is not None}.values())
    got = rows_of(tokencounts.upkeep(frame(spark, rows), "v1", PATH, PATTERN), "source", "lang", "version", "docs", "tokens")
    assert got == recount(rows, lambda t: len(known.encode_ordinary(t)), "v1")
    assert tokencounts.upkeep(empty, "v1", PATH, PATTERN).count() == 0


def test_ledger(spark, tmp_path):
    def entries(rows):
        return spark.createDataFrame(rows, tokencounts.ENTRY)

    def totals():
        return rows_of(ledger.totals(), "source", "lang", "version", "docs", "tokens")

    ledger = tokencounts.Ledger(spark, f"file://{tmp_path}/ledger")
    assert totals() == []
    assert ledger.commit("1", added=entries([(1, "a", "en", "v1", 1, 10), (2, "a", "en", "v1", 1, 5), (1, "a", "en", "v2", 1, 7), (3, None, None, "v1", 1, 1)]))
    assert not ledger.commit("1", added=entries([(9, "a", "en", "v1", 1, 99)]))
    first = totals()
    assert first == in_order([("a", "en", "v1", 2, 15), ("a", "en", "v2", 1, 7), (None, None, "v1", 1, 1)])
    # a revision moves a document to another source, for its version only; one that was unknown is new
    ledger.commit("2", revised=entries([(1, "b", "en", "v1", 1, 20), (8, "b", "en", "v1", 1, 2)]))
    assert totals() == in_order([("a", "en", "v1", 1, 5), ("a", "en", "v2", 1, 7), ("b", "en", "v1", 2, 22), (None, None, "v1", 1, 1)])
    ledger.commit("3", deleted=spark.createDataFrame([(1,), (77,), (1,)], "doc_id long"))
    assert totals() == in_order([("a", "en", "v1", 1, 5), ("b", "en", "v1", 1, 2), (None, None, "v1", 1, 1)])
    # entries of a batch that broke off before its sums are not seen, and a retry replaces them
    entries([(50, "z", "en", "v1", 1, 1000)]).write.parquet(f"{ledger.path}/entries/4")
    ledger.commit("4", deleted=spark.createDataFrame([(50,), (2,)], "doc_id long"))
    assert totals() == in_order([("b", "en", "v1", 1, 2), (None, None, "v1", 1, 1)])
