"""Quality rules of documents and of the hosts they come from, in Spark expressions only.

Method: every document is measured by row expressions; rule failures are summed by host (partial sums
before the shuffle), and each host's failure rate is shrunk towards the mean by a beta prior whose strength
comes from the spread of the hosts' rates. A host whose shrunk rate passes the limit is under strict rules:
there a document that fails any soft rule goes, too. A clean document stays whatever its host.

Cases: null text has no words and fails; a null host is a host of its own; repeated rows and ids keep their
rows; an empty table gives no rows; a single host takes its own rate as the mean. The caller's columns
travel in one struct, so their names cannot clash with the measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rows import compute_once
from ..session import cut_lineage
from .common import words

WINDOW = 5


def covered(positions: Column, width: int) -> Column:
    """Words covered by windows of ``width`` at sorted distinct positions."""
    steps = F.transform(positions, lambda p, k: F.coalesce(F.least(F.lit(width), F.get(positions, k + 1) - p), F.lit(width)))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns as struct ``row``, with the measures of column ``text``.

    Costly arrays are columns of their own, each used by the next step, and so computed once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t.alias("t"))
    df = df.withColumn("w", words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "row",
        "w",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    size = F.size("w")
    # the hash of each window of words; a text without equal hashes has no repeats
    grams = F.transform(
        F.slice("w", 1, F.greatest(size - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(F.col("w"), i + k) for k in range(1, WINDOW)]),
    )
    df = df.select(
        "row",
        "word_chars",
        "n_symbols",
        size.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("g"),
    )
    found = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    none = F.expr("cast(array() as array<struct<g:bigint,i:int>>)")
    df = df.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), found).otherwise(none)).drop("g")
    s = F.col("s")
    twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))
    df = df.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    df = df.withColumn("n_repeat_words", covered(F.col("p"), WINDOW))
    # a filter on measures must not be pushed into the steps above, which would compute them again and again
    found = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return compute_once(df.select("row", found.alias("found")), "m", F.col("found")).select("row", "m.*")


def rules(df: DataFrame) -> DataFrame:
    """base_failed, and soft_failed of the rules that count for strict hosts only."""
    n = F.col("n_words")
    return df.withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)).withColumn(
        "soft_failed",
        (10 * F.col("n_symbols") > n) | (F.col("n_dup_lines") > 2) | (F.col("word_chars") > 12 * n) | (F.col("word_chars") < 2 * n),
    )


def host_rates(df: DataFrame, host: Column) -> DataFrame:
    """host, n, x, rate: the share of failed documents, shrunk by a beta prior fitted to all hosts by moments."""
    hosts = df.groupBy(host.alias("host")).agg(
        F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("x")
    )
    hosts = cut_lineage(hosts)
    # sums of powers give mean and spread in one pass: four numbers for the driver
    powers = [F.sum("n"), F.sum("x"), F.sum(F.col("x") * (F.col("x") / F.col("n"))), F.count("*")]
    n, x, xx, h = (v or 0 for v in hosts.agg(*powers).first())
    mean = x / n if n else 0.0
    spread = max(xx / n - mean * mean - mean * (1 - mean) * h / n, 1e-6) if n else 1.0
    strength = max(mean * (1 - mean) / spread - 1, 1.0)
    return hosts.select("host", "n", "x", ((F.col("x") + strength * mean) / (F.col("n") + strength)).alias("rate"))


def verdicts(df: DataFrame, rates: DataFrame, host: str, limit: float) -> DataFrame:
    """Join the hosts' verdicts back: column ``kept``. Few strict hosts are broadcast by their size, many are shuffled."""
    strict = cut_lineage(rates.where(F.col("rate") > limit).select("host", F.lit(True).alias("strict")))
    out = df.join(strict, F.col("row")[host].eqNullSafe(F.col("host")), "left").drop("host")
    out = out.withColumn("strict", F.coalesce("strict", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("strict") & F.col("soft_failed")))


def judged(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """doc_id (in ``row``) with its measures and verdict; the texts are read once, the measures written."""
    df = measures(docs.select("doc_id", host, "text"))
    df = cut_lineage(rules(df.withColumn("row", F.struct(F.col("row.doc_id").alias("doc_id"), F.col("row")[host].alias(host)))))
    return verdicts(df, host_rates(df, F.col("row")[host]), host, limit)


def keep_good(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """The kept documents, with their own columns.

    Measures are computed for the hosts and again for the documents: that is cheaper than writing all texts once more.
    """
    rates = host_rates(rules(measures(docs.select(host, "text"))), F.col("row")[host])
    return verdicts(rules(measures(docs)), rates, host, limit).where("kept").select("row.*")
