"""Rates, latencies, camera state and counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequences

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def fps_report(ticks: DataFrame) -> DataFrame:
    """Frames a second per camera: the inverse of the mean gap between frames. The
    gaps of a camera add up to its whole span, so one small aggregate is enough. The row
    ``total`` is the sum over the cameras."""
    spans = ticks.groupBy("camera_id").agg(
        F.count("*").alias("frames"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi")
    )
    gap = (F.col("hi") - F.col("lo")) / 1000.0 / (F.col("frames") - 1)
    each = spans.select(
        "camera_id", "frames", F.when((F.col("frames") > 1) & (F.col("hi") > F.col("lo")), 1 / gap).otherwise(0.0).alias("fps")
    )
    total = each.agg(F.sum("frames").alias("frames"), F.sum("fps").alias("fps")).where("frames is not null")
    return each.unionByName(total.select(F.lit("total").alias("camera_id"), "frames", "fps"))


def rolling_fps(ticks: DataFrame, window_ms: int = 5_000, chunk_ms: int = 60_000) -> DataFrame:
    """(n-1)/(last-first) over the trailing window at each frame. A frame also
    enters the next time chunk if it can be in a window there."""
    at = F.floor(F.col("ts_ms") / chunk_ms)
    reach = F.floor((F.col("ts_ms") + window_ms) / chunk_ms)
    copies = ticks.withColumn("_chunk", F.explode(F.sequence(at, reach)))
    w = Window.partitionBy("camera_id", "_chunk").orderBy("ts_ms").rangeBetween(-window_ms, 0)
    seen = copies.withColumns({"_n": F.count("*").over(w), "_first": F.min("ts_ms").over(w)})
    span = F.col("ts_ms") - F.col("_first")
    fps = F.when((F.col("_n") > 1) & (span > 0), (F.col("_n") - 1) * 1000.0 / span).otherwise(0.0)
    return seen.where(F.col("_chunk") == at).select(*ticks.columns, fps.alias("fps"))


def ewma(ticks: DataFrame, value: str, order: Sequence[str], alpha: float = 0.3, chunk_ms: int = HOUR_MS) -> DataFrame:
    """Exponential mean per camera at the end of each chunk, starting from 0.

    A chunk acts on the running mean as ``e -> b + (1-alpha)^n * e``; ``b`` and
    ``n`` are computed chunk by chunk in parallel, and only these pairs are
    folded, one per chunk of the time span.
    """
    keep = 1.0 - alpha
    rows = ticks.withColumn("chunk", F.floor(F.col("ts_ms") / chunk_ms))
    newest = Window.partitionBy("camera_id", "chunk").orderBy(*[F.col(c).desc() for c in order])
    weighted = rows.withColumn("_k", F.row_number().over(newest) - 1).withColumn(
        "_w", F.col(value) * alpha * F.pow(F.lit(keep), F.col("_k"))
    )
    pairs = weighted.groupBy("camera_id", "chunk").agg(F.sum("_w").alias("b"), F.count("*").alias("n"))
    steps = pairs.groupBy("camera_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "b", "n"))).alias("steps"))
    # an empty list whose element type is that of the steps added below
    empty = F.slice(F.array(F.struct(F.lit(0).cast("bigint").alias("chunk"), F.lit(0.0).alias("ewma"))), 1, 0)

    def add(done: Column, s: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1))["ewma"], F.lit(0.0))
        now = s["b"] + last * F.pow(F.lit(keep), s["n"])
        return F.concat(done, F.array(F.struct(s["chunk"].alias("chunk"), now.alias("ewma"))))

    folded = F.aggregate("steps", empty, add)
    return steps.select("camera_id", F.explode(folded).alias("s")).select("camera_id", "s.chunk", "s.ewma")


# fixed values: camera states
OFFLINE, DEGRADED, ONLINE = 0, 1, 2


def camera_status(
    ticks: DataFrame, row_id: str = "event_id", degraded_ms: int = 10_000, offline_ms: int = 60_000
) -> DataFrame:
    """Add ``status``: how long the camera has been failing without a break."""
    order, chunk = ["ts_ms", row_id], F.floor(F.col("ts_ms") / DAY_MS)
    seen = sequences.neighbour(ticks, ["camera_id"], order, {"_before": "ok"}, chunk)
    starts = F.when(~F.col("ok") & F.coalesce("_before", F.lit(True)), F.col("ts_ms"))
    since = sequences.last_known(seen, ["camera_id"], order, starts, chunk, "_since")
    age = F.col("ts_ms") - F.col("_since")
    status = F.when(F.col("ok") | (age < degraded_ms), ONLINE).when(age < offline_ms, DEGRADED).otherwise(OFFLINE)
    return since.withColumn("status", status).drop("_before", "_since")


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, indexes: DataFrame, width: float = 1.0
) -> DataFrame:
    """Exact values at 0-based sorted positions, without sorting a key in one task.

    ``indexes``: keys, name, idx. Equal values are counted before the shuffle,
    and positions come from a running count over ``width``-wide value ranges.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = sequences.running_total(counts, keys, ["_v"], F.col("_n"), F.floor(F.col("_v") / width), "_upto")
    hit = (F.col("idx") < F.col("_upto")) & (F.col("idx") >= F.col("_upto") - F.col("_n"))
    return upto.join(indexes, list(keys)).where(hit).select(*keys, "name", "idx", F.col("_v").alias("value"))


def latency_percentiles(df: DataFrame, keys: Sequence[str], value: str, width: float = 1.0) -> DataFrame:
    """p50/p95/p99 by the report's rule: the value at index ``int(n * p)``."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    spots = [
        F.struct(F.lit(name).alias("name"), F.least(F.col("n") - 1, F.floor(F.col("n") * p)).alias("idx"))
        for name, p in (("p50", 0.50), ("p95", 0.95), ("p99", 0.99))
    ]
    indexes = sizes.select(*keys, F.explode(F.array(*spots)).alias("s")).select(*keys, "s.name", "s.idx")
    found = order_statistics(df, keys, value, indexes, width)
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == p, F.col("value"))).alias(p) for p in ("p50", "p95", "p99")]
    )


def recent_percentiles(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, last: int = 256) -> DataFrame:
    """The live registry's rule over the newest ``last`` samples of each label set:
    p50 at ``n/2 - 1``, the others at ``int(n * p)``. Older samples are dropped
    before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    kept = df.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= last)
    lists = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("s"))
    n = F.size("s")

    def at(i: Column) -> Column:
        return F.element_at("s", (i + 1).cast("int"))

    return lists.select(
        *keys,
        at(F.greatest(F.lit(0), F.floor(n / 2) - 1)).alias("p50"),
        at(F.least(n - 1, F.floor(n * 0.95))).alias("p95"),
        at(F.least(n - 1, F.floor(n * 0.99))).alias("p99"),
        n.cast("bigint").alias("samples"),
    )


def approximate_percentiles(df: DataFrame, keys: Sequence[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """The same report in one pass, within 1/accuracy of the rank."""
    return df.groupBy(*keys).agg(
        *[F.percentile_approx(value, p, accuracy).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    )


def counters(df: DataFrame, name: str, label: Column) -> DataFrame:
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("value")).select(F.lit(name).alias("counter"), "label", "value")


def sample_every_n(
    tracklets: DataFrame, every: int = 50, limit: int | None = None, bucket: str = "labeler", site: str = "site_1"
) -> DataFrame:
    """Every n-th tracklet in time order with its labelling path; a tracklet
    without a crop restarts the count. Numbering is by day, not in one task."""
    order, day = ["start_ms", "tracklet_id"], F.floor(F.col("start_ms") / DAY_MS)
    missing = F.coalesce(F.col("best_crop_uri") == "", F.lit(True))
    runs = sequences.running_total(tracklets, [], order, missing.cast("bigint"), day, "_run")
    numbered = sequences.row_numbers(runs.where(~missing), ["_run"], order, day, "_n")
    path = F.concat_ws(
        "/", F.lit(bucket), F.lit(site), "camera_id", F.date_format(F.timestamp_millis("start_ms"), "yyyy/MM/dd"), F.concat("tracklet_id", F.lit(".jpg"))
    )
    picked = numbered.where(F.col("_n") % every == 0).withColumn("staged_key", path).drop("_run", "_n")
    return picked if limit is None else picked.orderBy(*order).limit(limit)
