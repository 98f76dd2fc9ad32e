"""Tracklets: runs of detections of one local track, and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import sequences
from .detections import DAY_MS, drop_overlapping

KEYS = ["camera_id", "local_track_id"]


def tracklet_id(camera: Column, track: Column, start_ms: Column) -> Column:
    """The same id for the same run on every retry."""
    return F.substring(F.sha2(F.concat_ws("|", camera, track, start_ms), 256), 1, 16)


def stable_tracks(df: DataFrame, min_age: int = 15) -> DataFrame:
    """Detections from a track's ``min_age``-th one on."""
    numbered = sequences.row_numbers(
        df, KEYS, ["ts_ms", "det_id"], F.floor(F.col("ts_ms") / DAY_MS), "age_frames"
    )
    return numbered.where(F.col("age_frames") >= min_age)


def build(
    df: DataFrame,
    gap_ms: int = 30_000,
    min_detections: int = 15,
    min_crops: int = 5,
    max_crops: int = 15,
    max_embeddings: int = 15,
) -> DataFrame:
    """Close a track after ``gap_ms`` of silence and summarize each run.

    Input: camera_id, local_track_id, det_id, ts_ms, zone_id, x1..y2, and
    optionally crop_uri, quality (crops) and embedding. Kept are runs with enough
    crops, enough detections, or any embedding. Crops of quality 0 do not count; where no
    crop has a score, the first one stands for the tracklet with quality 0.
    ``frame_bboxes`` holds the first ``max_crops`` of ``frame_count`` boxes, and
    ``embedding_count`` is at most ``max_embeddings`` of ``n_embeddings``.

    Rows are first reduced to gap-wide buckets, which never straddle two runs, so
    a long or hot track shrinks before any shuffle; the first ``max_crops`` boxes
    travel on their own path, trimmed per bucket before the shuffle as well.
    """
    rows = df
    for name, kind in (("crop_uri", "string"), ("quality", "double"), ("embedding", "array<float>")):
        if name not in df.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("bucket", F.floor(F.col("ts_ms") / gap_ms))
    at = F.struct("ts_ms", "det_id")
    has_crop = F.col("crop_uri").isNotNull()
    usable = F.col("quality") > 0
    best = F.struct(F.col("quality").alias("q"), (-F.col("ts_ms")).alias("t"), (-F.col("det_id")).alias("d"))
    part = rows.groupBy(*KEYS, "bucket").agg(
        F.min("ts_ms").alias("lo"),
        F.max("ts_ms").alias("hi"),
        F.count("*").alias("n"),
        F.count(F.when(has_crop & (usable | F.col("quality").isNull()), 1)).alias("crops"),
        F.count("embedding").alias("embeddings"),
        F.min(F.struct(at.alias("at"), "zone_id")).alias("first"),
        F.max(F.struct(at.alias("at"), "zone_id")).alias("last"),
        F.max(F.when(has_crop & usable, F.struct(best.alias("k"), "crop_uri"))).alias("best"),
        F.min(F.when(has_crop & F.col("quality").isNull(), F.struct(at.alias("at"), "crop_uri"))).alias("unscored"),
    )
    if max_crops > 0:
        part = part.join(_first_boxes(rows, max_crops), [*KEYS, "bucket"])
    numbered = sequences.number_runs(part, KEYS, gap_ms)
    aggs = []
    if max_crops > 0:
        # a run's early buckets already hold its first boxes: skip the later ones
        so_far = Window.partitionBy(*KEYS, "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        early = F.coalesce(F.sum("n").over(so_far), F.lit(0)) < max_crops
        numbered = numbered.withColumn("_first", F.when(early, F.struct("bucket", "boxes")))
        lists = F.transform(F.array_sort(F.collect_list("_first")), lambda s: s["boxes"])
        aggs = [F.slice(F.flatten(lists), 1, max_crops).alias("frame_bboxes")]
    closed = (
        numbered.groupBy(*KEYS, "run")
        .agg(
            F.min("lo").alias("start_ms"),
            F.max("hi").alias("end_ms"),
            F.min("first")["zone_id"].alias("start_zone_id"),
            F.max("last")["zone_id"].alias("end_zone_id"),
            F.sum("n").alias("frame_count"),
            F.sum("crops").alias("crop_count"),
            F.sum("embeddings").alias("n_embeddings"),
            F.least(F.sum("embeddings"), F.lit(max_embeddings)).alias("embedding_count"),
            F.max("best").alias("best"),
            F.min("unscored").alias("unscored"),
            *aggs,
        )
        .where(
            (F.col("crop_count") >= min_crops)
            | (F.col("frame_count") >= min_detections)
            | (F.col("embedding_count") > 0)
        )
    )
    out = closed.select(
        tracklet_id(F.col("camera_id"), F.col("local_track_id"), F.col("start_ms")).alias("tracklet_id"),
        *KEYS,
        "start_ms",
        "end_ms",
        "start_zone_id",
        "end_zone_id",
        F.coalesce("best.crop_uri", "unscored.crop_uri").alias("best_crop_uri"),
        F.coalesce(F.col("best.k.q"), F.when(F.col("crop_count") > 0, F.lit(0.0))).alias("quality_score"),
        "frame_count",
        "embedding_count",
        "n_embeddings",
        F.lit("pphuman").alias("source"),
        F.lit(False).alias("provisional"),
        *(["frame_bboxes"] if max_crops > 0 else []),
    )
    return out


def _first_boxes(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` boxes of each bucket in time order; the rest is dropped
    before the shuffle."""
    in_bucket = Window.partitionBy(*KEYS, "bucket").orderBy("ts_ms", "det_id")
    trimmed = (
        rows.select(*KEYS, "bucket", "ts_ms", "det_id", F.array("x1", "y1", "x2", "y2").alias("bbox"))
        .withColumn("_k", F.row_number().over(in_bucket))
        .where(F.col("_k") <= limit)
    )
    items = F.array_sort(F.collect_list(F.struct("ts_ms", "det_id", "bbox")))
    return trimmed.groupBy(*KEYS, "bucket").agg(F.transform(items, lambda s: s["bbox"]).alias("boxes"))


def auxiliary(aux: DataFrame, primary: DataFrame, window_ms: int = 1000, iou_above: float = 0.3) -> DataFrame:
    """Provisional tracklets from auxiliary boxes that no primary box explains,
    one per camera and auxiliary frame time."""
    alone = drop_overlapping(aux, primary, window_ms, iou_above)
    first = F.min(F.struct("aux_id", "x1", "y1", "x2", "y2")).alias("first")
    return (
        alone.withColumn("frame_key", F.expr("ts_ms div 200"))
        .groupBy("camera_id", "frame_key")
        .agg(
            F.min("ts_ms").alias("start_ms"),
            F.max("ts_ms").alias("end_ms"),
            F.count("*").alias("sightings"),
            first,
        )
        .select(
            "camera_id",
            F.col("frame_key").alias("local_track_id"),
            "start_ms",
            "end_ms",
            F.lit(1).cast("bigint").alias("frame_count"),
            (F.col("sightings") - 1).alias("embedding_count"),
            "sightings",
            F.array(*[F.col(f"first.{c}") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"),
            F.lit("sahi").alias("source"),
            F.lit(True).alias("provisional"),
        )
    )


def provisional_gate(df: DataFrame, sightings: int = 2) -> DataFrame:
    """Provisional tracklets count only once they were seen often enough."""
    return df.where(~F.col("provisional") | (F.col("sightings") >= sightings))


#: Numbers that a task holds before it passes its sums on.
HELD = 4 << 20


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Length-one mean of length-one vectors, by key.

    Tasks add up their vectors as arrays and pass on one sum per key (more if they hold too many numbers), so a
    key with very many vectors is one row per task, whatever the number of positions; sums of a key meet in
    sorted order, one after the other. Missing vectors and ones with gaps add nothing; a key without any other
    gets no row. Of vectors of different lengths, each position is the mean of those that have it.
    """
    fields = [df.schema[k] for k in keys]
    summed = T.StructType([*fields, T.StructField("_sum", T.ArrayType(T.DoubleType())), T.StructField("_n", T.LongType())])
    whole = T.StructType([*fields, T.StructField(vector, T.ArrayType(T.DoubleType()))])
    names, types = list(keys), to_arrow_schema(T.StructType(fields))

    def table(rows: list[tuple], arrays: list[pa.Array], more: list[str]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], types.field(i).type) for i in range(len(names))]
        return pa.record_batch([*columns, *arrays], names=[*names, *more])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def passed() -> pa.RecordBatch:
            rows = [k[:-1] for k in held]
            sums = pa.array([total for total, _ in held.values()], pa.list_(pa.float64()))
            return table(rows, [sums, pa.array([n for _, n in held.values()], pa.int64())], ["_sum", "_n"])

        for batch in batches:
            column = batch.column(len(names))
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            if column.flatten().null_count:
                length = np.where([v is not None and None not in v for v in column.to_pylist()], length, 0)
            for size in np.unique(length[length > 0]).tolist():
                rows = np.flatnonzero(length == size)
                some = batch.take(pa.array(rows))
                m = some.column(len(names)).flatten().cast(pa.float64()).to_numpy().reshape(-1, size)
                norm = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
                m = np.where(norm < 1e-12, m, m / np.maximum(norm, 1e-12))
                code = some.select(names).to_pandas().groupby(names, dropna=False, sort=False).ngroup().to_numpy()
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
                sums, counts = np.add.reduceat(m[order], starts, axis=0), np.diff(np.r_[starts, len(order)])
                found = some.select(names).take(pa.array(order[starts])).to_pylist()
                for key, total, n in zip(found, sums, counts.tolist()):
                    entry = held.setdefault((*(key[c] for c in names), size), [0.0, 0])
                    entry[0], entry[1] = entry[0] + total, entry[1] + n
            if sum(k[-1] for k in held) > HELD:
                yield passed()
                held.clear()
        if held:
            yield passed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, count = None, np.zeros(0), np.zeros(0)
        done: list[tuple[tuple, np.ndarray]] = []

        def finished() -> pa.RecordBatch:
            return table([k for k, _ in done], [pa.array([v for _, v in done], pa.list_(pa.float64()))], [vector])

        def close() -> None:
            mean = total / np.maximum(count, 1)
            norm = float(np.sqrt(mean @ mean))
            done.append((current, mean if norm < 1e-12 else mean / norm))

        for batch in batches:
            keys_ = zip(*(batch.column(i).to_pylist() for i in range(len(names))))
            for key, sums, n in zip(keys_, batch.column(len(names)), batch.column(len(names) + 1).to_pylist()):
                if key != current:
                    if current is not None:
                        close()
                    current, total, count = key, np.zeros(0), np.zeros(0)
                part = sums.values.to_numpy()
                wider = max(len(part), len(total))
                total, count = (np.pad(x, (0, wider - len(x))) for x in (total, count))
                total[: len(part)] += part
                count[: len(part)] += n
            if done:
                yield finished()
                done.clear()
        if current is not None:
            close()
            yield finished()

    partial = df.select(*keys, vector).mapInArrow(add, summed)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(meet, whole)
