"""The derived views as DataFrames; see ``sql_views`` for the same rules in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import vectors
from ..session import configure, cut_lineage, expect_parts
from . import dimensions

#: Events that one task takes; each becomes up to 24 detections.
TASK_ROWS = 50_000


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value}D"
    return str(value) if isinstance(value, int) else "'" + str(value) + "'"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _spread(self, df: DataFrame, key: str) -> DataFrame:
        """At most ``TASK_ROWS`` events in a task of what follows, and all cores in use: rows are
        still small here, before the steps that multiply them. Later shuffles get as many parts, which
        Spark joins to larger ones where they are small."""
        if df.isStreaming:
            # rows of a batch are not counted before it runs; a large file still goes to all cores
            return df.repartition(max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), key)
        parts = max(self.spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
        expect_parts(self.spark, parts)
        return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts, key)

    # ---- dimensions -------------------------------------------------------
    def _inline(self, rows: list[tuple], schema: str) -> DataFrame:
        """Literal rows as an inline table, whose size the planner knows."""
        names = [f.split()[0] for f in schema.split(", ")]
        body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
        return self.spark.sql(f"SELECT * FROM VALUES {body} AS v({', '.join(names)})")

    @cached_property
    def cameras(self) -> DataFrame:
        return self._inline(dimensions.CAMERAS, schemas.CAMERA)

    @cached_property
    def links(self) -> DataFrame:
        return self._inline(dimensions.LINKS, schemas.CAMERA_LINK)

    @cached_property
    def zones(self) -> DataFrame:
        return self._inline(dimensions.ZONES, schemas.ZONE)

    # ---- facts ------------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        """Events with integer times and the camera each one happens on."""
        return self._spread(self.table("events"), "event_id").select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            "props",
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
            F.concat(F.lit("CAM_0"), 1 + (F.col("user_id") + F.hour("ts")) % 5).alias("camera_id"),
        )

    @cached_property
    def detections(self) -> DataFrame:
        e = F.col("event_id")
        i = F.col("frame_id")
        x1 = ((e * 37 + i * 5) % 1700).cast("double")
        y1 = ((e * 53) % 800).cast("double")
        return (
            self.events.withColumn("frame_id", F.explode(F.sequence(F.lit(0).cast("bigint"), 4 + e % 20)))
            .withColumn("ts_ms", F.col("ts_ms") + i * 200)
            .select(
                "event_id",
                (e * 32 + i).alias("det_id"),
                "camera_id",
                F.col("user_id").alias("local_track_id"),
                "frame_id",
                F.expr("ts_ms div 200").alias("frame_no"),
                "ts_ms",
                x1.alias("x1"),
                y1.alias("y1"),
                (x1 + 40 + e % 80).alias("x2"),
                (y1 + 60 + e % 200).alias("y2"),
                ((40 + e % 60) / F.lit(100.0)).alias("score"),
                "event_type",
                "value",
            )
        )

    @cached_property
    def aux(self) -> DataFrame:
        """Boxes of a second detector: shifted, delayed and rescored copies."""
        e = F.col("event_id")
        shift = e % 120
        return self.detections.select(
            F.col("det_id").alias("aux_id"),
            "camera_id",
            "frame_id",
            (F.col("frame_no") * 200 + e % 90).alias("ts_ms"),
            (F.col("x1") + shift).alias("x1"),
            "y1",
            (F.col("x2") + shift).alias("x2"),
            "y2",
            ((30 + (e * 7 + F.col("frame_id")) % 70) / F.lit(100.0)).alias("score"),
        )

    @cached_property
    def raw_json(self) -> DataFrame:
        """Detections as JSON text, some of them broken in different ways."""
        d, k = self.detections, F.col("det_id") % 50

        def part(condition, *pieces):
            return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces]))

        whole = F.concat(
            F.lit('"bbox":['), F.concat_ws(",", "x1", "y1", "x2", "y2"), F.lit("]")
        )
        body = F.concat_ws(
            ",",
            part(k != 37, '"camera_id":"cam', F.substring("camera_id", 6, 1), '_merged"'),
            part(F.lit(True), '"frame_id":', F.col("frame_id").cast("string")),
            part(k == 17, '"local_track_id":"abc"'),
            part(~k.isin(7, 17), '"local_track_id":', F.col("local_track_id").cast("string")),
            part(k == 27, '"bbox":[1.0,2.0]'),
            part(~k.isin(27, 47), whole),
            part(~k.isin(7, 47), '"timestamp_ms":', F.col("ts_ms").cast("string"), ',"score":', F.col("score").cast("string")),
        )
        text = F.concat(F.lit("{"), body, F.when(k == 7, "").otherwise("}"))
        return d.select("det_id", text.alias("value"))

    @cached_property
    def tracklets(self) -> DataFrame:
        """One tracklet per event: the run of detections that the event starts."""
        e = F.col("event_id")
        zone = F.concat(F.lit("Z"), 1 + e % 6)
        return self.events.select(
            "event_id",
            F.concat(F.lit("T"), e).alias("tracklet_id"),
            "camera_id",
            F.col("user_id").alias("local_track_id"),
            F.col("ts_ms").alias("start_ms"),
            F.when(e % 23 != 0, F.col("ts_ms") + (4 + e % 20) * 200).alias("end_ms"),
            zone.alias("start_zone_id"),
            F.when(e % 7 != 0, F.concat(F.lit("Z"), 1 + (e * 5) % 6)).alias("end_zone_id"),
            F.when(e % 9 != 0, F.concat(F.lit("s3://crops/evidence/pending/site_1/"), F.col("camera_id"), F.lit("/T"), e, F.lit("/best.jpg"))).alias("best_crop_uri"),
            F.when(e % 17 != 0, (e % 101) / F.lit(100.0)).alias("quality_score"),
            (5 + e % 20).alias("frame_count"),
            (1 + e % 4).alias("embedding_count"),
            F.concat(F.lit("G"), F.col("user_id")).alias("truth_id"),
        )

    @cached_property
    def _vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id"), F.col("embedding").cast("array<double>").alias("e")
        )

    @cached_property
    def points(self) -> DataFrame:
        """One appearance vector per tracklet, near its person's base vector. The
        clock runs 300 times faster, so travel windows of seconds are met."""
        n = self.table("embeddings").count()
        v = self._vectors
        # the first two vectors belong together: they are mixed once per person, in a table as small as the vectors
        people = v.select(F.col("vec_id").alias("p"), ((7 * F.col("vec_id") + 3) % n).alias("q"), F.col("e").alias("a"))
        pairs = people.join(v.select(F.col("vec_id").alias("q"), F.col("e").alias("b")), "q")
        pairs = cut_lineage(pairs.select("p", F.transform(F.arrays_zip("a", "b"), lambda t: t["a"] + t["b"] * 0.15).alias("ab")))
        ev = self.events.withColumn("p", F.col("user_id") % n).withColumn("r", (11 * F.col("event_id") + 5) % n)
        first = self.events.agg(F.min("ts_ms")).scalar()
        # what an event carries through a shuffle is one vector as it is stored
        third = self.table("embeddings").select(F.col("vec_id").alias("r"), F.col("embedding").alias("c"))
        joined = ev.join(third, "r").join(pairs, "p")
        mixed = F.transform(
            F.arrays_zip("ab", "c"), lambda t: t["ab"] + t["c"].cast("double") * (0.1 * (F.col("event_id") % 7))
        )
        return (
            joined.withColumn("m", mixed)
            .select(
                F.concat(F.lit("T"), "event_id").alias("tracklet_id"),
                "event_id",
                "camera_id",
                (F.lit(1704067200) + F.floor((F.col("ts_ms") - first) / 300000)).alias("ts"),
                vectors.unit(F.col("m")).alias("vector"),
                F.when(F.col("event_id") % 17 != 0, (F.col("event_id") % 101) / F.lit(100.0)).alias("quality_score"),
                F.concat(F.lit("Z"), 1 + F.col("event_id") % 6).alias("zone_id"),
                F.concat(F.lit("G"), "user_id").alias("truth_id"),
            )
        )

    @cached_property
    def zone_events(self) -> DataFrame:
        """Entries and exits of people; a person's zone changes from day to day."""
        z = 1 + (F.col("user_id") + F.dayofmonth(F.timestamp_millis("ts_ms"))) % 6
        kind = F.when(F.col("event_type").isin("view", "click"), "enter").when(
            F.col("event_type").isin("purchase", "signup"), "exit"
        )
        return (
            self.events.withColumn("kind", kind)
            .where(F.col("kind").isNotNull())
            .select(
                "event_id",
                F.concat(F.lit("G"), F.col("user_id")).alias("global_id"),
                F.concat(F.lit("T"), F.col("event_id")).alias("tracklet_id"),
                F.concat(F.lit("CAM_0"), 1 + z % 5).alias("camera_id"),
                F.concat(F.lit("Zone "), z).alias("zone_id"),
                F.col("kind").alias("event_type"),
                "ts_ms",
            )
        )

    @cached_property
    def decision_inputs(self) -> DataFrame:
        """Best and second-best hits per tracklet, from id arithmetic."""
        e = F.col("event_id")
        s1 = (6000 + (e * 7919) % 4001) / F.lit(10000.0)
        s2 = (6000 + (e * 7919) % 4001 - (e * 104729) % 2000) / F.lit(10000.0)
        has1 = e % 13 != 0
        has2 = has1 & (e % 11 != 0)
        g1 = F.concat(F.lit("G"), F.col("user_id") + F.when(e % 10 == 0, 1).otherwise(0))
        return self.events.select(
            "event_id",
            F.concat(F.lit("T"), e).alias("tracklet_id"),
            "camera_id",
            F.col("user_id").alias("local_track_id"),
            "ts_ms",
            F.concat(F.lit("G"), F.col("user_id")).alias("truth_id"),
            F.when(has1, g1).alias("top1_global_id"),
            F.when(has1, F.concat(F.lit("CAM_0"), 1 + (e * 3) % 5)).alias("top1_camera_id"),
            F.when(has1, s1).alias("top1_score"),
            F.when(has2, F.concat(F.lit("G"), F.col("user_id") + 2)).alias("top2_global_id"),
            F.when(has2, F.concat(F.lit("CAM_0"), 1 + (e * 3 + 1) % 5)).alias("top2_camera_id"),
            F.when(has2, s2).alias("top2_score"),
            ((e * 31) % 240).cast("double").alias("time_diff_seconds"),
            F.when(e % 17 != 0, (e % 131) / F.lit(100.0)).alias("quality_score"),
            F.when(e % 5 != 0, F.concat(F.lit("Z"), e % 3)).alias("prev_zone_id"),
            F.when(e % 7 != 0, F.concat(F.lit("Z"), e % 4)).alias("new_zone_id"),
        )

    @cached_property
    def ticks(self) -> DataFrame:
        """Frame ticks per camera with a latency and a success flag."""
        return self.events.select(
            "event_id",
            "camera_id",
            "ts_ms",
            F.col("value").alias("latency_ms"),
            (F.col("event_type") != "error").alias("ok"),
        )
