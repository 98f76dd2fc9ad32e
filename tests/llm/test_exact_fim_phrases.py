"""Exact duplicates, fill-in-the-middle and phrases against plain code, on awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from cases import awkward, frame, in_order, prose, rows_of, sha

from mcid.llm import exact, fim, members, phrases

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def normal(text: str | None) -> str:
    return (text or "").translate(LOWER)


# ---- exact duplicates -----------------------------------------------------------------
def groups(rows: list[tuple]) -> list[tuple]:
    """doc_id, keep_id, group_size, kept, digest; the columns do not say which of equal rows stays."""
    by_text: dict[str, list] = defaultdict(list)
    for doc_id, text, *_ in rows:
        by_text[normal(text)].append(doc_id)
    out = []
    for text, ids in by_text.items():
        ids.sort(key=lambda i: (i is not None, i), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, sha(text)) for k, i in enumerate(ids)]
    return in_order(out)


COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def with_copies() -> list[tuple]:
    long = prose(40, 30)
    more = [(500 + k, long.upper() if k % 2 else long) for k in range(40)] + [(None, long), (None, long), (700, "É" + long), (701, "é" + long)]
    return awkward() + [(i, t, "en", "s", None) for i, t in more]


# chunks of 16 bytes make nearly every text a long one; a small prime makes most fingerprints collide
@pytest.mark.parametrize("chunk,prime", [(exact.CHUNK, exact.PRIME), (16, exact.PRIME), (16, 3), (1 << 16, 3)])
def test_exact_groups(spark, chunk, prime):
    rows = with_copies()
    assert rows_of(exact.judged(frame(spark, rows).repartition(5), chunk, prime), *COLUMNS) == groups(rows)


def test_exact_empty_and_kept_rows(spark, empty):
    assert exact.judged(empty).count() == 0
    rows = with_copies()
    kept = exact.keep_last(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = sorted(normal(r.text) for r in kept.collect())
    assert got == sorted({normal(r[1]) for r in rows})


def test_fingerprints_join():
    r = random.Random(5)
    for _ in range(200):
        a, b = r.randbytes(r.randrange(200)), r.randbytes(r.randrange(200))
        whole = (exact.shifted(exact.value(a), len(b)) + exact.value(b)) % exact.PRIME
        assert whole == exact.value(a + b)


def test_prime_is_safe():
    def prime(n: int) -> bool:
        d, s = n - 1, 0
        while d % 2 == 0:
            d, s = d // 2, s + 1
        for a in range(2, 40):
            x = pow(a, d, n)
            if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
                return False
        return True

    assert prime(exact.PRIME) and prime((exact.PRIME - 1) // 2)


def test_members_are_always_found(spark):
    r = np.random.default_rng(1)
    h = r.integers(-(1 << 63), (1 << 63) - 1, 3000)
    bits = members.bitmap(spark.createDataFrame([(int(x),) for x in h], "h long"), log_bits=16)
    assert members.holds(bits, h.view(np.uint64)).all()
    others = r.integers(-(1 << 63), (1 << 63) - 1, 3000).view(np.uint64)
    assert members.holds(bits, others).mean() < 0.05


# ---- fill in the middle ---------------------------------------------------------------
def plain_cut(doc_id, text: str | None) -> tuple:
    text = text or ""
    n = len(text)
    h1, h2, h3, h4 = fim.draws("1", doc_id)
    if not text or re.search("<P>|<S>|<M>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", a, b - a, sha(out), sha(text)


def test_fim_digests(spark):
    extra = [(900 + k, t, None, None, None) for k, t in enumerate(["a<P>b", "<M>", "<", "<S", "<<P", "é" * 9000, "👍a" * 5000, "\n", "<S<P<M"])]
    rows = awkward() + extra + [(1000 + k, prose(k, 30) + "<" * (k % 3), None, None, None) for k in range(120)]
    got = rows_of(fim.digests(frame(spark, rows).repartition(3)), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert got == in_order([plain_cut(r[0], r[1]) for r in rows])
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_empty_and_other_columns(spark, empty):
    assert fim.digests(empty).count() == 0
    made = fim.transform(frame(spark, awkward()))
    assert {"source", "row", "n", "form", "output"} <= set(made.columns)
    assert made.select(fim.restored("output", "form").alias("t"), "text").where("t <> coalesce(text, '')").isEmpty()


@pytest.mark.parametrize("unit,block", [(None, 1), (None, 7), (None, 4096), (r"\S+\s*", 5), (r"[^\n]*\n", 3), ("x", 2)])
def test_fenwick_finds_every_end(unit, block):
    text = "añ b👍👍c\n\nword wörd  x\nlast xx"
    pattern = None if unit is None else regex.compile(unit)
    body = text.encode()
    blocks = fim.Blocks(*fim.ends(body, pattern), block)
    stops = [0, *(range(1, len(text) + 1) if pattern is None else [m.end() for m in pattern.finditer(text) if m.end() > m.start()])]
    if stops[-1] < len(text):
        stops.append(len(text))
    assert blocks.total() == (len(stops) - 1, len(text))
    assert [blocks.end(k) for k in range(len(stops))] == [(len(text[:e].encode()), e) for e in stops]
    nothing = fim.Blocks(*fim.ends(b"", pattern), block)
    assert nothing.total() == (0, 0) and nothing.end(0) == (0, 0)


def test_fim_other_units(spark):
    rows = [(k, prose(k, 25), "en", "s", None) for k in range(60)]
    made = fim.transform(frame(spark, rows), seed="7", plain_above=100, unit=r"\S+\s*")
    for r in made.collect():
        h = fim.draws("7", r.doc_id)
        a, b = sorted((h[0] % (r.n + 1), h[1] % (r.n + 1)))
        words = re.findall(r"\S+\s*", r.text)
        assert r.n == len(words) == 25
        assert r.prefix_chars == len("".join(words[:a])) and r.middle_chars == len("".join(words[a:b]))


# ---- phrases ---------------------------------------------------------------------------
def counted(rows: list[tuple], longest: int) -> tuple[dict, Counter]:
    f: dict[str, Counter] = defaultdict(Counter)
    n: Counter = Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", normal(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def best(rows: list[tuple], least: int, longest: int, percent: int, top: int) -> list[tuple]:
    f, n = counted(rows, longest)
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if a >= least and " " in p}
        found = []
        for p, a in cand.items():
            w = p.split(" ")
            if any(100 * b >= percent * a for q, b in cand.items() if len(q.split(" ")) > len(w) and f" {p} " in f" {q} "):
                continue
            cuts = [(1000 * a * n[lang] // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((-score, -a, p.encode(), lang, p, a, c[" ".join(w[:k])], c[" ".join(w[k:])], n[lang], score))
        out += [(x[3], rank, *x[4:]) for rank, x in enumerate(sorted(found)[:top], 1)]
    return in_order(out)


NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def chatter(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    stock = ["by and large", "New York Times", "on the one hand", "à côté de", "a a a", "of the people by the people"]
    out = []
    for k in range(n):
        said = [r.choice(stock) if r.random() < 0.4 else r.choice(["the", "of", f"v{r.randrange(12)}", "The\tx"]) for _ in range(r.randrange(30))]
        ends = [r.choice([" ", " ", " ", ", ", ".", "\n", "  ", "\x0b"]) for _ in said]
        out.append((k, "".join(map("".join, zip(said, ends))), r.choice(["en", "fr", None]), "s", None))
    return out


@pytest.mark.parametrize("share,lowered,log_bits", [(0.3, 0.6, 26), (0.3, 4.0, 26), (0.0, 1.0, 26), (1.0, 1.0, 26), (0.3, 3.0, 12), (0.3, 3.0, 9), (0.0, 1.0, 11)])
def test_phrases_for_any_sample(spark, share, lowered, log_bits):
    """A poor sample, none, or all, and bitmaps that hold much by mistake: what is proposed never changes the result."""
    rows = awkward() + chatter(3, 150)
    got = rows_of(phrases.collocations(frame(spark, rows).repartition(4), 6, 5, 100, 40, share=share, lowered=lowered, log_bits=log_bits), *NAMES)
    assert got == best(rows, 6, 5, 100, 40) and len(got) > 60


def test_phrases_percent_and_ties(spark):
    rows = chatter(8, 80) + chatter(8, 80)
    got = rows_of(phrases.collocations(frame(spark, rows), 4, 3, 70, 15), *NAMES)
    assert got == best(rows, 4, 3, 70, 15)


def test_phrases_empty(spark, empty):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None, None, None), (2, " .,", "en", None, None)]), least=1).count() == 0


def test_a_full_bitmap_counts_all(spark):
    """Proposals that hold everything by mistake cost work and change nothing."""
    rows = chatter(5, 60)
    f, _ = counted(rows, 4)
    full = np.full(1 << 10, np.uint64(0xFFFFFFFFFFFFFFFF))
    got = phrases.count(frame(spark, rows).select("lang", "text"), *(phrases.Proposal(spark, b) for b in (full, None, None)), 4).where("size > 0")
    want = {(lang, p): a for lang, c in f.items() for p, a in c.items()}
    assert {(r.lang, r.phrase): r.n for r in got.collect()} == want
    by_digest = phrases.count(frame(spark, rows).select("lang", "text"), *(phrases.Proposal(spark, b) for b in (full, None, None)), 4, digests=True)
    assert {(r.lang, r.phrase): r.n for r in by_digest.where("size > 0").collect()} == want  # all are proposed
