"""Backlog and rates of running streams, as rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "query string, batch bigint, source string, input_rows bigint, rows_per_second double, start_offset string, end_offset string, latest_offset string"


def lag_rows(query: StreamingQuery) -> list[tuple]:
    """One row per source of each reported batch."""
    out = []
    for p in query.recentProgress:
        body = json.loads(p.json) if hasattr(p, "json") else p
        for s in body["sources"]:
            out.append(
                (
                    body.get("name") or body["id"],
                    int(body["batchId"]),
                    s["description"],
                    int(s["numInputRows"]),
                    float(s.get("processedRowsPerSecond") or 0.0),
                    *(json.dumps(s.get(k)) for k in ("startOffset", "endOffset", "latestOffset")),
                )
            )
    return out


def lag(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    return spark.createDataFrame(lag_rows(query), SCHEMA)
