"""Status log of processing steps: an append-only history per patient and step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUCCESS, FAILED = "success", "failed"


def latest_status(log: DataFrame) -> DataFrame:
    """Latest status of each patient and step; ``seq`` decides within one second."""
    return log.groupBy("subject_id", "script_name").agg(
        F.max_by("status", F.struct("processed_at", "seq")).alias("status")
    )


def done(log: DataFrame, script: str | None = None) -> DataFrame:
    """Patients and steps whose latest status is success."""
    of_step = log if script is None else log.where(F.col("script_name") == script)
    return latest_status(of_step).where(F.col("status") == SUCCESS).drop("status")


def summary(log: DataFrame) -> DataFrame:
    """Number of patients done, per step."""
    return done(log).groupBy("script_name").agg(F.count(F.lit(1)).alias("patients"))


def entries(subjects: DataFrame, script: str, status: str = SUCCESS) -> DataFrame:
    """Log rows for the given patients, to be appended."""
    return subjects.select(
        "subject_id",
        F.lit(script).alias("script_name"),
        F.current_timestamp().cast("timestamp_ntz").alias("processed_at"),
        F.lit(status).alias("status"),
    )


def missing_success(present: DataFrame, log: DataFrame, script: str) -> DataFrame:
    """Patients found in the graph that the log does not call done."""
    known = done(log, script).select("subject_id")
    return present.select("subject_id").distinct().join(known, "subject_id", "left_anti")


def needs_embedding(
    patients: DataFrame, vectors: DataFrame, log: DataFrame, required: Sequence[str]
) -> DataFrame:
    """Patients without a vector whose required steps are all done.

    Only the stored vector counts: a patient that the log calls embedded but
    that has none is taken again.
    """
    missing = patients.select("subject_id").join(
        vectors.where(F.col("vector").isNotNull()).select("subject_id"), "subject_id", "left_anti"
    )
    ready = (
        done(log)
        .where(F.col("script_name").isin(list(required)))
        .groupBy("subject_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == len(set(required)))
    )
    return missing.join(ready, "subject_id", "left_semi")
