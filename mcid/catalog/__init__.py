"""Named queries over the derived views, with the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str | None = None, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``; ``sql`` is its check."""

    def wrap(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql
        return fn

    return wrap


def load() -> None:
    from . import (  # noqa: F401
        boxes,
        detections,
        evaluation,
        identity,
        scores,
        storage,
        streams,
        telemetry,
        zones,
    )


__all__ = ["QUERIES", "ORACLES", "query", "load"]
