"""Schemas of the relations, as Spark reads them."""

from __future__ import annotations

from pyspark.sql import types as T

CAMERA = "camera_id string, name string, rtsp_url_env_key string, width int, height int, fps_target int, is_active boolean"
CAMERA_LINK = (
    "from_camera_id string, to_camera_id string, min_travel_seconds int, "
    "max_travel_seconds int, transition_probability double, enabled boolean"
)
ZONE = (
    "zone_id string, camera_id string, name string, polygon_json string, zone_type string, "
    "is_entry_zone boolean, is_exit_zone boolean, enabled boolean, ord int"
)
LABEL_FILE = T.StructType(
    [
        T.StructField("dataset_name", T.StringType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("schema_version", T.StringType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("labellers", T.ArrayType(T.StringType())),
        T.StructField("labelled_at", T.StringType()),
        T.StructField(
            "global_persons",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("global_person_id", T.StringType()),
                        T.StructField("notes", T.StringType()),
                        T.StructField(
                            "segments",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("camera_id", T.StringType()),
                                        T.StructField("start_frame", T.LongType()),
                                        T.StructField("end_frame", T.LongType()),
                                        T.StructField("start_time", T.DoubleType()),
                                        T.StructField("end_time", T.DoubleType()),
                                        T.StructField("bbox_track", T.StringType()),
                                        T.StructField("tracklet_id_hint", T.LongType()),
                                        T.StructField("quality_flag", T.StringType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
