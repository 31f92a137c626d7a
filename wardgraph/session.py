"""Session settings and the shared folder that long jobs use to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on. They are all session-level, so a
# job can apply them to a session it was handed.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Spark removes the shuffle files of a job that runs under this setting when the
# job ends; what a job has written is not computed a second time.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session and return it."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a
    local-mode session gets a folder of its own; a real cluster must set it,
    because a machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = sc.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="wardgraph-")
    return _local_dirs[app]


def written(df: DataFrame, name: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a scan of what was written.

    The result has no lineage back to its inputs, survives the loss of
    executors, and carries real sizes, so that Spark can choose join
    strategies from them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
