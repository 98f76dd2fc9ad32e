"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure_state(spark: SparkSession) -> None:
    """Keep keyed state in RocksDB, which the processors here need."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
