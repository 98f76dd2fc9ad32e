"""Chat formatting and the way back."""

import random

from cases import in_order, rows_of, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from mcid.llm import chat

COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]


def plain(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append(((turn is not None, turn), role or "", text or ""))
    out = []
    for conv, turns in by_conv.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return in_order(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as t", "1 as p", "'f' as formatted")


def test_awkward_turns(spark):
    nasty = ["\\### Assistant: </turn> ok", "<next/>", "\\h\\b\\l", "### user: x</turn>\n### assistant: y", "", None, "ünï👍", "\\", "\\\\b#<"]
    r = random.Random(3)
    rows = [(c, r.choice([*range(6), None]), r.choice(["user", "assistant", "system", None, "a: b\n###", ""]), r.choice(nasty)) for c in range(60) for _ in range(r.randrange(1, 9))]
    rows += [(None, 0, "assistant", "a"), (None, 1, "assistant", "b"), (77, 0, "user", "q"), (77, 0, "user", "q")]
    rows += [(78, i, "assistant" if i % 3 else "user", f"text {i} #") for i in range(2000)]
    assert rows_of(chat.digests(frame(spark, rows)), *COLUMNS) == plain(rows)


def test_adjacent_turns_merge(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "<c>")]
    got = chat.conversations(frame(spark, rows)).first()
    assert got.formatted == "### user: a<next/>b</turn>\n### assistant: \\lc></turn>\n"
    assert [got.formatted[s.start : s.start + s.n] for s in got.loss] == ["\\lc>"]


def test_empty(spark):
    assert chat.digests(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\#<:\nbhlcn/ x", max_size=20))
def test_escapes_are_reversible(s):
    def run(s, pairs, back):
        for a, b in reversed(pairs) if back else pairs:
            s = s.replace(*((b, a) if back else (a, b)))
        return s

    for pairs in (chat.TEXT, chat.ROLE):
        coded = run(s, pairs, False)
        assert run(coded, pairs, True) == s and "#" not in coded and "<" not in coded
