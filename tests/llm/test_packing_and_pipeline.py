"""Packing by its promises; the pipeline against its parts in plain code."""

import random

from cases import awkward, frame, in_order, prose, words
from test_near_and_repeats import passages, plain_near, plain_removed
from test_text_rules import plain_verdicts

import corpus_pipeline
from mcid.llm import packing


def test_each_item_takes_the_tightest_compatible_bin():
    r = random.Random(4)
    for _ in range(30):
        capacity = r.choice([10, 64, 100])
        items = sorted(((r.randrange(1, capacity + 1), r.randrange(6), r.randrange(30)) for _ in range(300)), reverse=True)
        bins, plain = packing.Bins(capacity), []
        for n, source, cluster in items:
            fits = [capacity - b["n"] for b in plain if capacity - b["n"] >= n and source not in b["s"] and cluster not in b["c"]]
            b, start = bins.place(n, 1 << source, 1 << cluster)
            assert capacity - start == min(fits, default=capacity)
            if b == len(plain):
                assert not fits
                plain.append({"n": 0, "s": set(), "c": set()})
            assert plain[b]["n"] == start and source not in plain[b]["s"] and cluster not in plain[b]["c"]
            plain[b]["n"] += n
            plain[b]["s"].add(source)
            plain[b]["c"].add(cluster)


def check_placement(rows, placed, capacity):
    source = {}
    by_id = {}
    for i, text, _, s, _ in rows:
        by_id.setdefault(i, []).append(len(words(text)))
        source[i] = s
    got = {}
    for doc, piece, n, b, start in placed:
        got.setdefault(doc, []).append(n)
    assert {i: sum(v) for i, v in by_id.items()} == {i: sum(v) for i, v in got.items()}
    bins = {}
    for doc, piece, n, b, start in placed:
        if b is not None:
            bins.setdefault(b, []).append((start, n, doc))
        else:
            assert n == 0
    for members in bins.values():
        members.sort(key=lambda m: m[:2])
        assert members[0][0] == 0 and all(a[0] + a[1] == z[0] for a, z in zip(members, members[1:]))
        assert members[-1][0] + members[-1][1] <= capacity
    return bins


def test_packing_holds_its_promises(spark, monkeypatch, empty):
    monkeypatch.setattr(packing, "SHARD", 300)
    r = random.Random(8)
    rows = awkward() + [(1000 + i, prose(i if i % 3 else 0, r.randrange(1, 90) if i % 3 else 30), "en", "hot" if i % 2 else f"s{i % 9}", 0) for i in range(800)]
    df = frame(spark, rows)
    placed = [tuple(x) for x in packing.pack(df, 128).select("doc_id", "piece", "n_words", "bin", "start").collect()]
    bins = check_placement(rows, placed, 128)
    source = {i: s for i, _, _, s, _ in rows if i is not None and i >= 1000}
    text = {i: t for i, t, *_ in rows if i is not None and i >= 1000}
    for members in bins.values():
        known = [d for _, _, d in members if d in source]
        assert len({source[d] for d in known}) == len(known) == len({text[d] for d in known})
    assert packing.pack(empty, 128).count() == 0


def test_pipeline(spark, tmp_path, monkeypatch):
    good = [(2000 + i, prose(3000 + i, 30 + i, 5000), "en", f"s{i % 4}", 0) for i in range(40)]
    rows = [r for r in awkward() if r[0] not in (17, 18)] + passages()[:140] + good + [(2100, good[0][1], "en", "s1", 0)]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = [tuple(x) for x in corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id", "piece", "n_words", "bin", "start").collect()]
    kept = {v[0] for v in plain_verdicts(rows) if v[-1]}
    left = [r for r in rows if r[0] in kept]
    stay = {i for i, _, c in plain_near(left) if i == c or i is None}
    left = [r for r in left if r[0] in stay]
    after = []
    for i, w, gone in plain_removed(left, 13):
        rest = [x for k, x in enumerate(w) if k not in gone]
        if rest:
            after.append((i, " ".join(rest), None, None, 0))
    check_placement(after, got, 2048)
    assert in_order([(r[0],) for r in after]) == in_order(list({(g[0],) for g in got}))


def test_stages_are_as_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "best_fit_packing"]
