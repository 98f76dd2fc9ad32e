"""Exact top-k against all scores; archives against the pages."""

import base64
import gzip
import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, frame, in_order, rows_of

from mcid.llm import search, warc


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_top(rows, k):
    docs = [(r[0], Counter(terms(r[1]))) for r in rows]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, c in docs:
        if i is not None and i % 100 == 0:
            asked.setdefault(i, set()).update(c)
    out = []
    for q, wanted in asked.items():
        scores = []
        for i, c in docs:
            hit = [t for t in wanted if t in c]
            if hit:
                dl = sum(c.values())
                s = sum(round(1e6 * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / mean)))) for t in hit)
                scores.append((-s, (i is not None, i)))
        out += [(q, rank, i[1], -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return in_order(out)


@pytest.mark.parametrize("k", [1, 10])
def test_top_k(spark, k, empty):
    r = random.Random(1)
    more = [(1000 + i, " ".join(f"t{int(r.paretovariate(0.7))}" for _ in range(r.randrange(1, 60))), "en", "s", 0) for i in range(600)]
    rows = awkward() + more
    df = frame(spark, rows)
    got = search.top_k(df, df.where("doc_id % 100 = 0"), k)
    assert rows_of(got, "query_id", "rank", "doc_id", "score") == plain_top(rows, k)
    if k == 1:
        assert search.top_k(empty, empty, k).count() == 0


def test_pruning_loses_nothing():
    r = np.random.default_rng(3)
    n, vocabulary = 5000, 300
    tf = {}
    for d in range(n):
        for t in np.minimum(r.zipf(1.3, r.integers(1, 80)), vocabulary) - 1:
            tf[int(t), d] = tf.get((int(t), d), 0) + 1
    lens = np.zeros(n, int)
    for (_, d), c in tf.items():
        lens[d] += c
    lists = {}
    for (t, d), c in sorted(tf.items()):
        lists.setdefault(t, ([], []))[0].append(d)
        lists[t][1].append(c)
    def packed(v, kind="<i4"):
        return np.array(v, kind).tobytes()

    rows = [{"seg": 0, "term": f"t{t}", "docs": packed(a), "tf": packed(b)} for t, (a, b) in lists.items()]
    rows.append({"seg": 0, "ids": packed(range(n), "<i8"), "lens": packed(lens)})
    shapes = {"seg": pa.int64(), "term": pa.string()} | dict.fromkeys(["docs", "tf", "ids", "lens"], pa.binary())
    shard = search.Shard(pa.Table.from_pylist(rows, pa.schema(list(shapes.items()))).to_batches(), lens.mean())
    for _ in range(60):
        asked = r.choice(len(shard.terms), r.integers(1, 40), replace=False)
        weight = r.uniform(0.05e6, 9e6, len(asked))
        full = np.zeros(n)
        for t, w in zip(asked, weight):
            for a in range(shard.list[t], shard.list[t + 1]):
                full[shard.doc[a]] += np.rint(w * shard.part[a])
        low = np.sort(full)[-10]
        want = {(int(d), full[d]) for d in np.flatnonzero(full >= max(low, 1))}
        assert set(zip(*(x.tolist() for x in shard.search(asked, weight, 10)))) >= want


def test_index_holds_numbers_for_words():
    words = np.random.default_rng(5).integers(0, 3000, (2000, 400))
    texts = [" ".join(f"someword{w}" for w in row) for row in words.tolist()]
    batch = pa.record_batch({"doc_id": pa.array(range(2000)), "text": pa.array(texts)})
    tracemalloc.start()
    rows = list(search.segments(iter([batch]), 7))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * words.size, peak / words.size
    assert sum(b.num_rows for b in rows) == 3001 and rows[-1].column("total").to_pylist() == [words.size]


def test_weights_may_change_between_queries():
    rows = [{"seg": 0, "term": t, "docs": np.array(d, "<i4").tobytes(), "tf": np.ones(len(d), "<i4").tobytes()} for t, d in (("a", [0, 1]), ("b", [1, 2]))]
    rows.append({"seg": 0, "ids": np.arange(3).astype("<i8").tobytes(), "lens": np.array([1, 2, 1], "<i4").tobytes()})
    shapes = {"seg": pa.int64(), "term": pa.string()} | dict.fromkeys(["docs", "tf", "ids", "lens"], pa.binary())
    shard = search.Shard(pa.Table.from_pylist(rows, pa.schema(list(shapes.items()))).to_batches(), 4 / 3)
    one, two, again = (shard.search(np.array([0]), np.array([w]), 3)[1] for w in (1e6, 2e6, 1e6))
    assert one.tolist() == again.tolist() and one.tolist() == np.rint(1e6 * shard.part[:2]).tolist()
    assert two.tolist() == np.rint(2e6 * shard.part[:2]).tolist()


PAGES = [
    (1, "http://b.example.com/x?q=1#f", "<p>one</p>"),
    (2, "https://a.example.com:8443/", "<p>two</p>"),
    (3, "http://b.example.com/x?q=1", "<p>one</p>"),
    (4, None, None),
    (5, "not a url\r\nWARC-Type: evil", ""),
    (6, "http://[bad", "WARC/1.1\r\n\r\n" * 50),
    (7, "http://b.example.com/x?q=1", "<p>ünï 👍</p>" * 2000),
    (None, "http://b.example.com/none", "<p>one</p>"),
    (None, "http://b.example.com/alone", "alone"),
    (8, "http://b.example.com/x?q=1", "<p>eight</p>"),
    (8, "http://b.example.com/x?q=1", "<p>eight</p>"),
    (9, "http://b.example.com/x?q=1", "<p>one</p>"),
    (10, "http://" + "l" * 400 + ".com/" + "p" * 600, "long"),
    (11, "http://" + "l" * 400 + ".com/" + "q" * 600, "long"),
]


def plain_pages(pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in pages:
        body = (h or "").encode()
        to = first.get(h or "")
        again = to is not None and i != to
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), sha, "revisit" if again else "response", to if again else None))
    return in_order(out)


def page_frame(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'k' as key", "1 as sha", "2 as size", "3 as archive")


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_captures(spark):
    r = random.Random(5)
    many = [(100 + i, f"http://h{r.randrange(40)}.example.com/{r.randrange(30)}", f"page {r.randrange(300)}") for i in range(900)]
    got = warc.captures(page_frame(spark, PAGES + many).repartition(3))
    assert rows_of(got, *COLUMNS) == plain_pages(PAGES + many)
    assert warc.captures(page_frame(spark, [])).count() == 0


def test_archives_are_gzipped_records_and_look_up(spark):
    store = warc.write(page_frame(spark, PAGES).coalesce(1))
    rows = store.orderBy("archive", "offset").collect()
    data = b"".join(bytes(r.record) for r in rows)
    assert all(data[r.offset : r.offset + r.length] == bytes(r.record) for r in rows)
    text = gzip.decompress(data)
    assert text.count(b"WARC-Record-ID: ") == len(PAGES) and b"\r\nWARC-Type: evil" not in text
    blocks = warc.capture_index(store, entries=4, least=2)
    directory = warc.Directory(blocks)
    assert len(directory.blocks) >= 4
    got = warc.lookup(store, blocks, directory, "https://b.example.com:443/x?q=1#other")
    assert sorted(r.page_id for r in got.collect()) == [1, 3, 7, 8, 8, 9]
    assert bytes(got.where("page_id = 7").first().payload).decode() == PAGES[6][2]
    assert [r.page_id for r in warc.lookup(store, blocks, directory, PAGES[13][1]).collect()] == [11]
    assert warc.lookup(store, blocks, directory, "http://zzz.example.org/").count() == 0
    everything = warc.locate(store.select("key").distinct(), blocks, directory)
    assert rows_of(everything, "archive", "offset") == rows_of(store, "archive", "offset")


def test_a_damaged_record_is_an_error():
    good = warc.record(1, "http://a.b/", b"payload", None, "2024-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n", b"pAyload\r\n"))


def test_keys_reverse_the_host():
    assert warc.surt("http://A.Example.com:80/x?y#z") == "com,example,a)/x?y"
    assert warc.surt("https://a.example.com:81") == "com,example,a:81)/"
    assert warc.surt(None) == "" and warc.surt("plain words") == "plain%20words"
