"""Quality rules and license scans against plain code."""

import re
from collections import Counter, defaultdict

from cases import awkward, frame, in_order, rows_of, words

from mcid.llm import licenses, quality

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(text):
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def failures(m):
    n, chars, symbols, dups, repeats = m
    return n < 10 or 100 * repeats > 20 * n, 10 * symbols > n or dups > 2 or chars > 12 * n or chars < 2 * n


def plain_verdicts(rows, limit=0.5):
    got = [(r[0], r[3], measured(r[1])) for r in rows]
    hosts = defaultdict(lambda: [0, 0])
    for _, source, m in got:
        hosts[source][0] += 1
        hosts[source][1] += any(failures(m))
    n, x = (sum(h[k] for h in hosts.values()) for k in (0, 1))
    mean = x / n
    spread = max(sum(b * b / a for a, b in hosts.values()) / n - mean**2 - mean * (1 - mean) * len(hosts) / n, 1e-6)
    strength = max(mean * (1 - mean) / spread - 1, 1)
    strict = {h for h, (a, b) in hosts.items() if (b + strength * mean) / (a + strength) > limit}
    out = []
    for i, source, m in got:
        base, soft = failures(m)
        out.append((i, *m, base, not base and not (source in strict and soft)))
    return out


def test_measures_and_verdicts(docs):
    got = quality.judged(docs).selectExpr("row.doc_id as doc_id", *MEASURES, "base_failed", "kept")
    assert rows_of(got, "doc_id", *MEASURES, "base_failed", "kept") == in_order(plain_verdicts(awkward()))


def test_a_clean_document_of_a_bad_host_stays(spark):
    good = " ".join(f"word{i}" for i in range(60))
    noisy = " ".join(f"#w{i}#" for i in range(60))
    rows = [(i, "junk", "en", "bad", 4) for i in range(40)] + [(100, good, "en", "bad", 1), (101, noisy, "en", "bad", 1)]
    rows += [(200 + i, good + f" {i}", "en", f"ok{i % 3}", 1) for i in range(60)] + [(300, noisy, "en", "ok1", 1)]
    kept = {r[0] for r in rows_of(quality.keep_good(frame(spark, rows)), "doc_id")}
    assert kept == {100, 300, *range(200, 260)}
    assert kept == {r[0] for r in plain_verdicts(rows) if r[-1]}


def test_keep_good_returns_the_columns(docs, empty):
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(empty).count() == 0 and quality.judged(empty).count() == 0


def plain_base(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, found = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        if at:
            found.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


LICENSED = [
    "Released under the MIT License. Licensed under CC BY-NC 4.0. Apache License, Version 2.0!",
    "under the mit license under the mit license",
    "This work is licensed under the GNU General Public License, version 3.",
    "Not under the mit licenses. cc_by_nc",
    "CC BY NC SA 4.0",
    "SPDX-License-Identifier: MPL-2.0",
    "public  domain",
]


def test_base_places(spark, docs):
    rows = awkward() + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(LICENSED)] + [(2000, "under the mit license " * 3000, "en", "s", 0)]
    got = rows_of(licenses.scan(frame(spark, rows)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == in_order([(r[0], *plain_base(r[1])) for r in rows])


def test_labels_and_suppression(spark, empty):
    got = licenses.scan(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(LICENSED)]))
    labels = [r[1] for r in rows_of(got, "doc_id", "labels")]
    assert labels == ["apache-2,cc-by-nc,mit", "mit", "gpl-3", "cc-by-nc", "cc-by-nc,cc-by-nc-sa", "mpl-2", "public-domain"]
    for r in got.select("hits", "score", "labels", "base_labels").collect():
        assert 0 <= r.score <= 1 and bool(r.labels) == (r.score > 0)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        for h in r.hits:  # no kept interval lies in another of equal or better priority
            assert not any(o is not h and o.a <= h.a and o.z >= h.z and o.p <= h.p for o in r.hits)
    assert licenses.scan(empty).count() == 0


def test_rules_are_many_and_gated():
    table = licenses.rule_table()
    assert len(table) > 300 and all(re.compile(r[3]) for r in table)


NOTICES = [
    ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: ISC", "isc"),
    ("SPDX-License-Identifier: EPL-2.0", "epl-2"),
    ("SPDX-License-Identifier: BSL-1.0", "bsl-1"),
    ("This file is licensed under MIT.", "mit"),
    ("released under the BSD license", "bsd"),
    ("It comes under the GPL", "gpl"),
    ("GNU Lesser General Public License", "lgpl"),
    ("The FreeBSD License applies", "bsd-2"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("We met at MIT, and FreeBSD ran there. Permission was asked.", ""),
]


def test_usual_notices(spark):
    got = rows_of(licenses.scan(frame(spark, [(i, t, "en", "s", 0) for i, (t, _) in enumerate(NOTICES)])), "doc_id", "labels")
    assert got == [(i, want) for i, (_, want) in enumerate(NOTICES)]


def examples(tree):
    """A shortest and a longest text of a parsed pattern, once for each branch."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "NOT_LITERAL":
            more = ["x"]
        elif name == "IN":
            more = ["x" if str(arg[0][0]) == "NEGATE" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, sub = arg
            more = [x * k for k in sorted({least, min(int(most), 2)} if least else {0, 1}) for x in examples(sub)]
        elif name == "SUBPATTERN":
            more = examples(arg[3])
        elif name == "BRANCH":
            more = [x for sub in arg[1] for x in examples(sub)]
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
            more = [""]
        out = [a + b for a in out for b in more]
    return out


def test_every_rule_can_be_reached():
    stems = re.compile(licenses.STEMS.replace("\\x{10FFFF}", "\U0010ffff"))
    for _, label, key, pattern, _ in licenses.rule_table():
        for line in {x + " " for x in examples(re._parser.parse(pattern))}:
            assert re.search(pattern, line) and key in line and stems.search(line.strip()), (label, key, line)
