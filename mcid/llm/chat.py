"""Chat formatting in Spark expressions only, with an exact way back.

Method: the turns of a conversation are collected as structs and sorted; array expressions mark where the
role changes, so that adjacent turns of one role form one block, and concatenate the pieces. Marks are
``### role: `` before a block, ``<next/>`` between the turns inside it, and ``</turn>`` with a line break
after it. ``#``, ``<`` and the backslash are escaped in texts, and ``:`` in roles, so no text can hold a mark.

The loss mask is a list of spans (first character, number) of the formatted string: the assistant texts.

Cases: null text or role counts as empty; turns with equal numbers go by role, then text; a null turn comes
first; repeated rows are turns of their own; rows without conv_id form one conversation; an empty table gives
no rows; other columns of the input are not read, so their names cannot clash. A conversation is one row of
output, so its text must fit in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NEXT, CLOSE = "### ", "<next/>", "</turn>\n"
#: Escape pairs; the backslash comes first when escaping and last on the way back.
TEXT = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE = [*TEXT, (":", "\\c"), ("\n", "\\n")]


def escape(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for plain, code in pairs:
        s = F.replace(s, F.lit(plain), F.lit(code))
    return s


def unescape(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for plain, code in reversed(pairs):
        s = F.replace(s, F.lit(code), F.lit(plain))
    return s


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans of assistant texts)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("t"))
    t = F.col("t")

    def piece(x: Column, i: Column) -> Column:
        before, after = F.get(t, i - 1)["role"], F.get(t, i + 1)["role"]
        head = F.when(before == x["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), escape(x["role"], ROLE), F.lit(": ")))
        tail = F.when(after == x["role"], F.lit("")).otherwise(F.lit(CLOSE))
        return F.struct(head.alias("head"), escape(x["text"], TEXT).alias("body"), tail.alias("tail"), (x["role"] == "assistant").alias("loss"))

    pieces = turns.select("conv_id", F.transform("t", piece).alias("p"))

    def span(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["head"])
        found = F.when(x["loss"], F.concat(acc["out"], F.array(F.struct(at.alias("start"), F.length(x["body"]).alias("n"))))).otherwise(acc["out"])
        return F.struct((at + F.length(x["body"]) + F.length(x["tail"])).alias("at"), found.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,n:int>>)").alias("out"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.aggregate("p", start, span)["out"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text, formatted, from the formatted string and its mask alone."""
    blocks = F.split("formatted", CLOSE)

    def turns(block: Column) -> Column:
        split_at = F.instr(block, ": ")
        role = unescape(F.substring(block, F.lit(len(OPEN) + 1), split_at - len(OPEN) - 1), ROLE)
        texts = F.split(F.substring(block, split_at + 2, F.length(block)), NEXT)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x, TEXT).alias("text")))

    inner = F.slice(blocks, 1, F.size(blocks) - 1)
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["n"]), TEXT))
    return formatted.select("conv_id", F.flatten(F.transform(inner, turns)).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = read_back(conversations(rows))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
