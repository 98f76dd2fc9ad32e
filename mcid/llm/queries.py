"""One query per operator over its whole table, with production parameters, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact, fim, licenses, oracles, packing, phrases, quality, search, simhash, substrings, tokencounts, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 100 = 0"), k=10)


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, n=3)


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages")).drop("url")


#: A conversation whose texts look like the template's own marks.
MARKS = "\\### Assistant: </turn> ok"


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-7, k, role, MARKS) for k, role in enumerate(("user", "assistant"))]
    return chat.digests(rows.unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string")))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("hits")


@query
def op7_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokencounts.upkeep(table(spark, sf_dir, "documents"), "byte_bpe_50k", path, public_tokenizers.PATTERN)


@query
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"), window=13)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.judged(table(spark, sf_dir, "documents")).drop("fingerprint")


@query
def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


ORACLES |= {"op1_search": oracles.SEARCH, "op3_warc": oracles.WARC, "op4_chat": oracles.CHAT, "op5_quality": oracles.QUALITY, "op8_substrings": oracles.SUBSTRINGS}
ORACLES |= {"op11_exact": oracles.EXACT, "op12_fim": oracles.FIM, "op13_phrases": oracles.PHRASES}
