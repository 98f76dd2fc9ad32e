"""SimHash components and repeated passages against plain code."""

import random

import pytest
import xxhash
from cases import awkward, frame, in_order, prose, rows_of, sha, words

from mcid.llm import common, simhash, substrings


def plain_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=3):
    """Smallest reachable label of each place."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= radius:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def plain_near(rows):
    prints = [plain_print(r[1]) for r in rows]
    tops = plain_components(prints)
    out = []
    for r, p, t in zip(rows, prints, tops):
        ids = [x[0] for x, y in zip(rows, tops) if y == t and x[0] is not None]
        out.append((r[0], f"{p:016x}", min(ids, default=None)))
    return in_order(out)


def test_near_duplicates(docs, empty):
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == plain_near(awkward())
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_first(docs, empty):
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    want = {c for i, _, c in plain_near(awkward()) if i == c and i is not None}
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 2
    assert simhash.keep_first(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair(radius):
    r = random.Random(radius)
    first = simhash.masks(radius)
    for _ in range(2000):
        diff = sum(1 << b for b in r.sample(range(64), radius))
        met = [m for m in first if not m & diff]
        assert met
        for m in met[:1]:  # the second family covers what the first mask leaves out
            assert any(not x & diff for x in simhash.masks(radius, (2**64 - 1) & ~m))


def crowd(n):
    """Fingerprints in chains and clumps around a few centres."""
    r = random.Random(9)
    out = set()
    for _ in range(3):
        at = r.getrandbits(64)
        for _ in range(n):
            for b in r.sample(range(64), r.choice([1, 2, 3, 5])):
                at ^= 1 << b
            out.add(at)
        base = r.getrandbits(64)
        out |= {base ^ sum(1 << b for b in r.sample(range(12), r.randrange(5))) for _ in range(4 * n)}
    return sorted(out)


@pytest.mark.parametrize("bucket", [2, 40, 8192])
def test_links_keep_the_components(spark, bucket):
    prints = crowd(60)
    fps = spark.createDataFrame([(simhash.signed(p), k) for k, p in enumerate(prints)], "fp long, low long")
    links = [tuple(r) for r in simhash.links(fps, 3, bucket).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links)
    roots = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain_components(prints)
    groups = {}
    for k, p in enumerate(prints):
        s = simhash.signed(p)
        groups.setdefault(roots.get(s, s), set()).add(want[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_removed(rows, window):
    low = {}
    for i, text, *_ in rows:
        w = words(text)
        for p in range(len(w) - window + 1 if i is not None else 0):
            g = tuple(w[p : p + window])
            low[g] = min(i, low.get(g, i))
    out = []
    for i, text, *_ in rows:
        w, gone = words(text), set()
        for p in range(len(w) - window + 1 if i is not None else 0):
            if low[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i, w, gone))
    return out


def passages(seed=4):
    """Documents that share passages, some of them often."""
    r = random.Random(seed)
    shared = [prose(100 + k, r.randrange(10, 60)) for k in range(6)]
    rows = []
    for i in range(150):
        parts = [prose(1000 + i, r.randrange(0, 40))]
        for _ in range(r.randrange(4)):
            parts += [r.choice(shared[: 1 + r.randrange(6)]), prose(5000 + 7 * i, r.randrange(1, 9))]
        rows.append((i % 140, "  ".join(parts), "en", "s", 0))
    return rows


@pytest.mark.parametrize("group", [1, 20, 20_000])
def test_removed_words(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    rows = awkward() + passages()
    got = rows_of(substrings.digests(frame(spark, rows), 13), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = [(i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))) for i, w, gone in plain_removed(rows, 13)]
    assert got == in_order(want)


def test_remove_repeats_keeps_the_rest_as_it_is(spark, empty):
    rows = [(1, prose(1, 40), "en", "s", 0), (2, "Head\n\n " + prose(1, 40) + " tail\tend", "en", "s", 0), (3, prose(1, 40), "en", "s", 0), (4, None, "en", "s", None), (5, "clean  text\n", "en", "s", 12)]
    df = frame(spark, rows)
    got = substrings.remove_repeats(df, 13)
    assert got.columns == df.columns
    assert rows_of(got, "doc_id", "text", "n_chars") == in_order(
        [(1, rows[0][1], 0), (2, "Head\n\n tail\tend", 15), (4, None, None), (5, "clean  text\n", 12)]
    )
    assert substrings.remove_repeats(empty).count() == 0 and substrings.digests(empty).count() == 0


def test_walk_settles_paths_across_batches_and_parts():
    import pyarrow as pa

    r = random.Random(2)
    rows = sorted((f"p{r.randrange(9)}", r.randrange(6), 0, k) for k in range(400))
    low = {}
    for w, d, *_ in rows:
        low[w] = min(d, low.get(w, d))
    want = sorted((d, p) for w, d, _, p in rows if d > low[w])
    names = ["words", "doc_id", "rid", "pos"]
    for size in (1, 3, 50, 1000):
        for cut in (0, 133, 257):
            settled, left = [], []
            for part in (rows[:cut], rows[cut:]):
                batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part[k : k + size])], names) for k in range(0, len(part), size)]
                for b in substrings.walk(iter(batches)):
                    for w, d, _, p in zip(*(b.column(i).to_pylist() for i in range(4))):
                        (settled if w is None else left).append((w, d, p))
            lows = {}
            for w, d, _ in left:
                lows[w] = min(d, lows.get(w, d))
            got = [(d, p) for _, d, p in settled] + [(d, p) for w, d, p in left if d > lows[w]]
            assert sorted(got) == want
