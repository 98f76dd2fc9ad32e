"""Chunked windows equal plain ones, whatever the chunks and however hot the key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mcid.operators import rangejoin, sequences, telemetry


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(5)}", rnd.randrange(0, 5000), i, rnd.choice([None, rnd.randrange(9)])) for i in range(1500)]
    return spark.createDataFrame(rows, "k string, t bigint, id bigint, v bigint").cache()


@pytest.mark.parametrize("width", [7, 300, 10_000])
def test_chunked_windows(events, width):
    w = Window.partitionBy("k").orderBy("t", "id")
    chunk = F.floor(F.col("t") / width)
    plain = events.select(
        "id",
        F.lag("v").over(w).alias("p"),
        F.lead("id").over(w).alias("f"),
        F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.row_number().over(w).cast("bigint").alias("n"),
        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("l"),
    )
    args = ["k"], ["t", "id"]
    out = sequences.neighbour(events, *args, {"p": "v"}, chunk)
    out = sequences.neighbour(out, *args, {"f": "id"}, chunk, following=True)
    out = sequences.running_total(out, *args, F.col("id"), chunk, "s")
    out = sequences.row_numbers(out, *args, chunk, "n")
    out = sequences.last_known(out, *args, F.col("v"), chunk, "l")
    assert sorted(map(str, out.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_global_numbers(events):
    out = sequences.row_numbers(events, [], ["t", "id"], F.floor(F.col("t") / 100), "n")
    assert sorted(r.n for r in out.collect()) == list(range(1, 1501))


def test_order_statistics(spark):
    rnd = random.Random(2)
    values = [float(rnd.choice([7.5, rnd.random() * 50])) for _ in range(999)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    idx = spark.createDataFrame([("a", str(i), i) for i in (0, 17, 500, 998)], "k string, name string, idx bigint")
    got = {r.idx: r.value for r in telemetry.order_statistics(df, ["k"], "v", idx, 3.0).collect()}
    assert got == {i: sorted(values)[i] for i in (0, 17, 500, 998)}


def test_range_joins(spark):
    rnd = random.Random(9)
    left = [(i, "a", lo, lo + rnd.randrange(0, 90)) for i, lo in enumerate(rnd.randrange(0, 500) for _ in range(60))]
    right = [(i, "a", rnd.randrange(0, 600)) for i in range(80)]
    a = spark.createDataFrame(left, "i bigint, k string, lo bigint, hi bigint")
    b = spark.createDataFrame(right, "j bigint, k string, at bigint")
    got = sorted((r.i, r.j) for r in rangejoin.range_join(a, b, ["k"], "lo", "hi", "at", 25).collect())
    assert got == sorted((x[0], y[0]) for x in left for y in right if x[2] <= y[2] <= x[3])
    c = a.select(F.col("i").alias("j"), "k", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = sorted((r.i, r.j) for r in rangejoin.overlap_join(a, c, ["k"], "lo", "hi", "lo2", "hi2", 25).collect())
    assert both == sorted((x[0], y[0]) for x in left for y in left if x[2] <= y[3] and y[2] <= x[3])
