"""Zone entries and exits, stays, and the statistics built on stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequences

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def _days(ts: str = "ts_ms") -> Column:
    return F.floor(F.col(ts) / DAY_MS)


def transitions(df: DataFrame, row_id: str = "det_id") -> DataFrame:
    """Entries and exits from a person's zone sightings.

    Input: global_id, camera_id, zone_id (NULL outside), ts_ms, and a row id for
    equal times. A change of zone exits the old one and enters the new one.
    """
    seen = sequences.neighbour(
        df, ["global_id"], ["ts_ms", row_id], {"_zone": "zone_id", "_camera": "camera_id"}, _days()
    )
    changed = seen.where(~F.col("_zone").eqNullSafe(F.col("zone_id")))
    event = F.array(
        F.struct(F.lit("exit").alias("event_type"), F.col("_zone").alias("zone_id"), F.col("_camera").alias("camera_id")),
        F.struct(F.lit("enter").alias("event_type"), F.col("zone_id"), F.col("camera_id")),
    )
    return (
        changed.select("global_id", "ts_ms", row_id, F.explode(event).alias("e"))
        .where("e.zone_id IS NOT NULL")
        .select("global_id", "e.camera_id", "e.zone_id", "e.event_type", "ts_ms", row_id)
    )


def sessions(events: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Stays per person and zone. A repeated entry is ignored, and so is an exit
    without an entry; a stay without an exit stays open.

    Input: global_id, zone_id, camera_id, event_type, ts_ms and a row id.
    """
    keys, order = ["global_id", "zone_id"], ["ts_ms", row_id]
    marked = sequences.neighbour(events, keys, order, {"_before": "event_type"}, _days())
    inside = F.coalesce(F.col("_before") == "enter", F.lit(False))
    turns = marked.where(
        ((F.col("event_type") == "enter") & ~inside) | ((F.col("event_type") == "exit") & inside)
    ).select(*keys, "camera_id", "event_type", *order)
    closed = sequences.neighbour(turns, keys, order, {"exited_ms": "ts_ms"}, _days(), following=True)
    seconds = F.greatest(F.lit(0), F.floor((F.col("exited_ms") - F.col("ts_ms")) / 1000))
    return closed.where(F.col("event_type") == "enter").select(
        *keys,
        "camera_id",
        F.col("ts_ms").alias("entered_ms"),
        "exited_ms",
        F.when(F.col("exited_ms").isNotNull(), seconds).alias("duration_seconds"),
        F.when(F.col("exited_ms").isNull(), "open").otherwise("closed").alias("status"),
    )


def force_close(stays: DataFrame, now_ms: Column, max_open_seconds: int = 86_400) -> DataFrame:
    """Close stays open for longer than the limit, at ``now_ms``."""
    stale = (F.col("status") == "open") & (now_ms - F.col("entered_ms") > max_open_seconds * 1000)
    seconds = F.floor((now_ms - F.col("entered_ms")) / 1000)
    return stays.withColumns(
        {
            "exited_ms": F.when(stale, now_ms).otherwise(F.col("exited_ms")),
            "duration_seconds": F.when(stale, seconds).otherwise(F.col("duration_seconds")),
            "status": F.when(stale, "closed").otherwise(F.col("status")),
        }
    )


def with_validity(stays: DataFrame, now_ms: Column, min_seconds: float = 120.0) -> DataFrame:
    """Add ``dwell_seconds`` (so far, for open stays), ``valid`` and ``pending``."""
    so_far = (F.coalesce(F.col("exited_ms"), now_ms) - F.col("entered_ms")) / 1000.0
    return (
        stays.withColumn("dwell_seconds", so_far)
        .withColumn("valid", F.col("dwell_seconds") >= min_seconds)
        .withColumn("pending", (F.col("status") == "open") & ~F.col("valid"))
    )


def zone_summary(events: DataFrame, stays: DataFrame) -> DataFrame:
    """People inside, entries, exits, mean stay and distinct people per zone."""
    counted = events.groupBy("camera_id", "zone_id").agg(
        F.count(F.when(F.col("event_type") == "enter", 1)).alias("entries"),
        F.count(F.when(F.col("event_type") == "exit", 1)).alias("exits"),
    )
    people = stays.groupBy("camera_id", "zone_id").agg(
        F.count(F.when(F.col("status") == "open", 1)).alias("people_count"),
        F.avg("duration_seconds").alias("dwell_avg_seconds"),
        F.countDistinct("global_id").alias("active_global_ids"),
    )
    return counted.join(people, ["camera_id", "zone_id"], "left").na.fill(
        {"people_count": 0, "dwell_avg_seconds": 0.0, "active_global_ids": 0}
    )


def _avg0(value: Column) -> Column:
    return F.round(F.coalesce(F.avg(value), F.lit(0.0)), 2)


def _max0(value: Column) -> Column:
    return F.round(F.coalesce(F.max(value), F.lit(0.0)), 2)


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def zone_gauges(stays: DataFrame, keys: tuple[str, ...] = ("zone_id",)) -> DataFrame:
    """Current state per zone: people inside, mean and longest valid stay, pending."""
    valid = F.when(F.col("valid"), F.col("dwell_seconds"))
    return stays.groupBy(*keys).agg(
        _count_if(F.col("status") == "open").alias("current_count"),
        _avg0(valid).alias("avg_dwell"),
        _max0(valid).alias("longest_dwell"),
        _count_if(F.col("pending")).alias("pending_entries"),
        F.count("*").alias("total_entered"),
        _count_if(F.col("status") == "closed").alias("total_exited"),
        _count_if(F.col("valid")).alias("valid_entries"),
    )


def zone_windowed(stays: DataFrame, width_ms: int) -> DataFrame:
    """Counts and stays per zone and tumbling window: entries by entry time, exits
    and stay lengths by exit time."""
    entered = stays.groupBy("zone_id", (F.floor(F.col("entered_ms") / width_ms) * width_ms).alias("window_ms")).agg(
        F.count("*").alias("entries"), _count_if(F.col("valid")).alias("valid_entries")
    )
    left = (
        stays.where("exited_ms IS NOT NULL")
        .groupBy("zone_id", (F.floor(F.col("exited_ms") / width_ms) * width_ms).alias("window_ms"))
        .agg(
            F.count("*").alias("exits"),
            _avg0(F.col("duration_seconds")).alias("avg_dwell"),
            _max0(F.col("duration_seconds").cast("double")).alias("longest_dwell"),
        )
    )
    zero = {"entries": 0, "valid_entries": 0, "exits": 0, "avg_dwell": 0.0, "longest_dwell": 0.0}
    return entered.join(left, ["zone_id", "window_ms"], "full").na.fill(zero)


def zone_ranks(stays: DataFrame, now_ms: Column) -> DataFrame:
    """Busiest, most visited and longest visited zone, overall and for the last
    hour and day. The first zone wins a tie; no zone gives N/A."""

    def since(width: int | None) -> tuple[Column, Column]:
        if width is None:
            return F.lit(True), F.col("exited_ms").isNotNull()
        lo = now_ms - width
        return F.col("entered_ms") >= lo, F.coalesce(F.col("exited_ms") >= lo, F.lit(False))

    aggs = [_count_if(F.col("status") == "open").alias("current")]
    spans = {"": None, "_hourly": HOUR_MS, "_daily": DAY_MS}
    for tag, width in spans.items():
        entered, exited = since(width)
        aggs.append(_count_if(entered).alias(f"visits{tag}"))
        mean = F.avg(F.when(exited, F.col("duration_seconds")))
        aggs.append(F.round(F.coalesce(mean, F.lit(0.0)), 6).alias(f"stay{tag}"))
    per_zone = stays.groupBy("zone_id").agg(*aggs)

    def leader(metric: str, name: str) -> Column:
        return F.coalesce(F.min_by("zone_id", F.struct(-F.col(metric), "zone_id")), F.lit("N/A")).alias(name)

    picks = [leader("current", "busiest_zone")]
    for tag in spans:
        picks += [leader(f"visits{tag}", f"most_visited_zone{tag}"), leader(f"stay{tag}", f"longest_visited_zone{tag}")]
    return per_zone.agg(*picks)


def camera_dwell(stays: DataFrame, now_ms: Column, approximate: bool = False) -> DataFrame:
    """Stays and distinct people per camera, overall and for the last hour and day."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    hour, day = now_ms - HOUR_MS, now_ms - DAY_MS
    valid = F.when(F.col("valid"), F.col("dwell_seconds"))
    return stays.groupBy("camera_id").agg(
        _avg0(F.col("duration_seconds")).alias("avg_camera_dwell"),
        _max0(F.col("duration_seconds").cast("double")).alias("longest_camera_dwell"),
        distinct("global_id").alias("unique_people"),
        distinct(F.when(F.col("entered_ms") >= hour, F.col("global_id"))).alias("unique_people_hourly"),
        distinct(F.when(F.col("entered_ms") >= day, F.col("global_id"))).alias("unique_people_daily"),
        _count_if(F.col("pending")).alias("total_pending"),
        _avg0(valid).alias("avg_dwell_time"),
        _max0(valid).alias("longest_dwell_time"),
    )


def delta_counters(df: DataFrame, keys: list[str], at: str, value: str, epoch: str | None = None) -> DataFrame:
    """Growth of each counter since it was last published; no growth, no row.

    ``epoch`` counts resets: after one, the baseline is 0 again.
    """
    parts = [*keys, epoch] if epoch else keys
    seen = sequences.neighbour(df, parts, [at], {"_last": value}, _days(at))
    return (
        seen.withColumn("delta", F.col(value) - F.coalesce("_last", F.lit(0)))
        .where(F.col("delta") != 0)
        .drop("_last")
    )
