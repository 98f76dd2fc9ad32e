import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mcid import session


class Cluster:
    """A session that says it runs on a cluster, with a shared folder of that name."""

    def __init__(self, spark, folder):
        self._spark, self.sparkContext = spark, self
        self._context, self.master, self.applicationId = spark.sparkContext, "spark://host:7077", uuid.uuid4().hex
        self.conf = {"spark.checkpoint.dir": folder}

    def __getattr__(self, name):
        return getattr(self._spark if hasattr(self._spark, name) else self._context, name)


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_a_mounted_folder_is_shared(spark, tmp_path, scheme):
    folder = f"{scheme}{tmp_path}/shared"
    assert session.shared_dir(Cluster(spark, folder)) == folder
    assert list((tmp_path / "shared").iterdir()) == []  # nothing is left of the trial


def test_a_folder_that_is_not_shared_stops_the_job(spark, tmp_path, monkeypatch):
    """Part files that the driver does not see would be missing rows."""
    cluster = Cluster(spark, str(tmp_path))
    empty = f"{tmp_path}/empty"
    spark.range(0).write.parquet(empty)

    class Read:
        def schema(self, _):
            return self

        def parquet(self, _):
            return spark.read.parquet(empty)

    monkeypatch.setattr(cluster, "read", Read(), raising=False)
    with pytest.raises(RuntimeError, match="do not share"):
        session.shared_dir(cluster)


def test_other_file_systems_are_taken_as_named(spark):
    assert session.shared_dir(Cluster(spark, "hdfs://nn/shared")) == "hdfs://nn/shared"


def test_exploded_rows_are_not_broadcast_by_the_size_of_their_file(spark, tmp_path):
    """A file of 4 MB that holds 3 million boxes after the explode."""
    ids = spark.range(300_000).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id % 1500 AS user_id", "'view' AS event_type", "rand(7) AS value", "'' AS props")
    ids.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    other = spark.newSession()
    other.conf.set(session.BROADCAST, "10MB")
    other.conf.unset(session.MEASURED_BROADCAST)
    plan = entry.queries()["bbox_iou"](other, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert other.conf.get(session.MEASURED_BROADCAST) == "10MB"  # what is small in truth still is
    other.conf.set(session.BROADCAST, "-1")
    assert session.configure(other).conf.get(session.BROADCAST) == "-1"


def test_tasks_get_no_more_events_with_more_input(spark, tmp_path, monkeypatch):
    from mcid.fixtures import Views, spark_views

    monkeypatch.setattr(spark_views, "TASK_ROWS", 100)
    rows = spark.range(3000).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01' AS ts", "id % 9 AS user_id", "'view' AS event_type", "1D AS value", "'' AS props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    other = spark.newSession()
    views = Views(other, str(tmp_path))
    assert views.events.rdd.getNumPartitions() == 30
    assert other.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "30"
    assert views.detections.count() == sum(5 + e % 20 for e in range(3000))


def test_an_event_carries_one_vector_through_the_shuffles(spark):
    """Vectors beyond the bound of a broadcast: two joins by event, not three."""
    other = spark.newSession()
    other.conf.set(session.BROADCAST, "-1")
    plan = entry.queries()["mean_vector"](other, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 2


def test_vectors_of_a_batch_are_scaled_together(spark):
    import numpy as np

    from mcid.operators import embedding

    def ten_threes(part):
        assert len(part) <= 4
        return np.full((len(part), 3), 3.0)

    def ragged(part):
        return [None if i % 3 == 0 else np.ones(2 + i % 3) for i in part["id"]]

    rows = spark.range(0, 10, 1, 1)
    got = embedding.embed_crops(rows, ten_threes, 3, batch=4).collect()
    assert [round(x, 6) for r in got for x in r.embedding] == [0.57735] * 30
    got = embedding.embed_crops(rows, ragged, 3, batch=4).collect()
    assert [r.id for r in got if r.embedding is not None] == [1, 4, 7]
    assert embedding.embed_crops(rows.limit(0), ragged, 3).count() == 0


def test_shuffle_files_go_with_their_job(spark):
    """Each step of a job that is cut into steps would keep its shuffle on disk until the driver's garbage is collected."""
    import time

    from mcid.session import configure, cut_lineage

    configure(spark)

    def files():
        return {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before = files()
    kept = cut_lineage(spark.range(10_000).repartition(7).groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 100
