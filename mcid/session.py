"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that every job needs for right results or for scale; a cluster's own
# values for anything else are left alone.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a job's shuffle files go when it ends, not when the driver happens to collect its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

#: Before a join has run, the planner knows only the size of files, which may be a hundredth of the rows that come out of them
#: (packed columns, then an explode). So only what is small by this bound is broadcast at once; larger inputs are shuffled,
#: and are broadcast if their true size then allows it.
PLANNED_BROADCAST = 1 << 20
BROADCAST, MEASURED_BROADCAST = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
UNITS = {unit: 1 << 10 * i for i, unit in enumerate(["b", "k", "m", "g", "t"])}


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([bkmgt]?)(?:b|ib)?\s*", text.lower()).groups()
    return int(number) * UNITS[unit or "b"]


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    named = spark.conf.get(BROADCAST)
    if _bytes(named) > PLANNED_BROADCAST:
        if spark.conf.get(MEASURED_BROADCAST, None) is None:
            spark.conf.set(MEASURED_BROADCAST, named)
        spark.conf.set(BROADCAST, str(PLANNED_BROADCAST))
    return spark


def expect_parts(spark: SparkSession, parts: int) -> None:
    """Let shuffles begin with at least so many parts; small ones are joined to larger ones as they come."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if parts > int(spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(key, str(parts))


def local_session(cores: str | int = 8, app: str = "mcid", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


#: Folders that were tried out, by application.
_tried: set[tuple[str, str]] = set()


def _try_out(spark: SparkSession, folder: str) -> None:
    """Stop if what executors write to ``folder`` does not reach the driver."""
    key = (spark.sparkContext.applicationId, folder)
    if key in _tried:
        return
    n = max(2, spark.sparkContext.defaultParallelism)
    path = f"{folder}/mcid-try-{uuid.uuid4().hex}"
    spark.range(0, n, 1, n).write.parquet(path)
    try:
        seen = spark.read.schema("id bigint").parquet(path).count()
    except Exception:  # an executor does not find the file of another one
        seen = -1
    if seen != n:
        raise RuntimeError(f"spark.checkpoint.dir is {folder}, which the driver and the executors do not share; name a folder that they do")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _tried.add(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only when none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        # a path without a scheme, or of file:, may be a mount that all machines have, so it is tried out
        if not spark.sparkContext.master.startswith("local") and not re.match(r"(?!file:)[a-z][a-z0-9+.-]*:", named, re.I):
            _try_out(spark, named)
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files.

    An executor lost later costs one reread instead of the whole history. Files
    also give the planner true sizes, and loops start each round with a fresh plan
    (a checkpointed plan keeps inferred constraints, which grow with the rounds).
    """
    path = f"{shared_dir(df.sparkSession)}/mcid-cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_cuts(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more; other files stay."""
    for cut in cuts:
        spark = cut.sparkSession
        for folder in {f.rpartition("/")[0] for f in cut.inputFiles()}:
            if "/mcid-cut-" in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
