"""Awkward documents, and plain rewrites of what the operators promise."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use inside.
CLASHES = {"n_words": "7", "row": "'r'", "fp": "1", "t": "'t'", "w": "'w'", "pos": "3", "rid": "5", "kept": "false", "bin": "9", "shard": "4", "n": "2", "host": "'h'", "query": "6", "key": "'k'"}


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward() -> list[tuple]:
    shared = prose(1, 60)
    texts = [
        (0, prose(2, 200) + " " + shared),
        (1, shared + "\n" + prose(3, 90)),
        (2, prose(2, 200) + " " + shared),  # exact copy of 0
        (3, prose(2, 200) + " " + shared + " end"),  # near copy of 0
        (4, None),
        (5, ""),
        (6, " \t\n\x0b\x0c\r "),
        (7, "one two"),
        (8, "Ünïcode wörds ARE words, too: ñ 日本語 👍 a\u00a0b\u2003c"),
        (9, "a b c d e " * 40),
        (10, "line one here\nline one here\nline two\n\nline one here\n###$$$%%%"),
        (11, prose(4, 6000, 3000)),
        (12, "Released under the MIT License. Licensed under CC BY-NC 4.0. Apache License, Version 2.0!"),
        (13, prose(5, 13)),
        (14, prose(5, 13)),
        (15, prose(5, 12)),
        (16, "x" * 5000),
        (None, prose(6, 40)),
        (None, None),
        (17, prose(7, 50)),
        (17, prose(7, 50)),  # repeated row
        (18, prose(8, 30)),
        (18, prose(9, 30)),  # repeated id
        (100, prose(4, 50, 3000)),
        (200, shared),
        (300, None),
    ]
    return [(i, t, None if k % 7 == 3 else "en", None if k % 5 == 4 else f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"{v} as {c}" for c, v in CLASHES.items()])


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def in_order(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
