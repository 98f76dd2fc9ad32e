"""Near copies by five-word shingles against all pairs in plain code."""

import random
from fractions import Fraction

import numpy as np
from cases import awkward, frame, in_order, prose, rows_of

import corpus_pipeline
from mcid.llm import jaccard


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_copies(rows):
    sets, root = [plain_set(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a & b and Fraction(len(a & b), len(a | b)) >= Fraction(4, 5)):
                root = [root[j] if x == root[i] else x for x in root]
    best = {}
    for r, t in zip(rows, root):
        best[t] = min((x for x in (best.get(t), r[0]) if x is not None), default=None)
    return in_order([(r[0], best[t]) for r, t in zip(rows, root)])


def edited():
    """Texts and copies with scattered edits, on both sides of the threshold; a chain; exactly 0.8."""
    r, rows = random.Random(3), []
    for k in range(60):
        w = prose(500 + k, r.randrange(20, 300), 9000).split()
        rows.append((3000 + 10 * k, " ".join(w)))
        for c in range(1, 4):
            v = list(w)
            for _ in range(r.randrange(1, 2 + len(w) // 25)):
                v[r.randrange(len(v))] = f"x{r.randrange(10**6)}"
            rows.append((3000 + 10 * k + c, " ".join(v)))
    chain = prose(77, 90, 9000).split()
    rows += [(5000 + k, " ".join(chain[4 * k : 4 * k + 54])) for k in range(9)]
    edge = prose(78, 14, 9000).split()
    rows += [(6000, " ".join(edge)), (6001, " ".join(edge[:12])), (6002, " ".join(edge[:11]))]
    return [(i, t, "en", "s", len(t)) for i, t in rows]


def test_components_equal_all_pairs(spark, empty):
    rows = awkward() + edited()
    want = plain_copies(rows)
    assert 20 < sum(i != c for i, c in want if i is not None and i >= 3000) < 180  # both sides occur
    for most in (1 << 22, 40):  # one task a group, and pairs of blocks
        assert rows_of(jaccard.near_copies(frame(spark, rows), most=most), "doc_id", "component_id") == want
    assert jaccard.near_copies(empty).count() == 0


def test_stage_takes_copies_beyond_three_bits(spark):
    w = prose(91, 248, 9000).split()
    v = w[:60] + ["other"] + w[61:150] + ["words"] + w[151:]
    rows = [(1, " ".join(w), "en", "s", 0), (2, " ".join(v), "en", "s", 0), (3, prose(92, 248, 9000), "en", "s", 0)]
    prints = [simprint(r[1]) for r in rows]
    assert (prints[0] ^ prints[1]).bit_count() > 3
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == [1, 3]


def simprint(text):
    from mcid.llm.simhash import fingerprint

    return fingerprint(text.encode())


def test_bands_meet_at_the_threshold():
    r, missed = np.random.default_rng(1), 0
    for _ in range(300):
        x = r.integers(0, 2**64, 90, np.uint64)
        a, b = (np.frombuffer(k, np.int64) for k in jaccard.band_keys([x[:81], x[9:]]))  # 72 of 90
        missed += not (a == b).any()
    assert missed == 0 and (1 - 0.8**jaccard.ROWS) ** jaccard.BANDS < 1e-5


def test_components_of_proposals_hold_no_limit():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in range(0, 400, 5)]
    found = jaccard.forest(list(range(80)), sets, (4, 5))
    assert len(found) == 79  # one chain, one tree


def test_simhash_proposes_all_that_are_within_its_bits(spark):
    """Without any band: the fingerprints of five-word sets, found by the covering masks."""
    rows = edited()
    sets = [jaccard.shingles(r[1].encode()) for r in rows]
    prints = {jaccard.set_id(s): jaccard.fingerprint(s) for s in sets if len(s)}
    assert all(p == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in s) > len(s)) for s, p in ((s, jaccard.fingerprint(s)) for s in sets[:20]))
    by_set = jaccard.sketches(frame(spark, rows)).dropDuplicates(["sid"])
    met = [(r.a % 2**64, r.b % 2**64) for r in jaccard.near_prints(by_set).collect()]
    root = {s: s for s in prints}
    for a, b in met:
        old, new = root[a], root[b]
        assert (prints[a] ^ prints[b]).bit_count() <= jaccard.RADIUS
        root = {k: new if r == old else r for k, r in root.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= jaccard.RADIUS]
    assert near and all(root[a] == root[b] for a, b in near)
