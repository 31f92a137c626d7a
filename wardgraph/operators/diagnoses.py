"""Diagnosis lists of admissions and patients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.functions.clinical import UNKNOWN, or_default
from wardgraph.functions.text import trimmed
from wardgraph.operators.bundles import ordered_list


def admission_list(diagnoses: DataFrame) -> DataFrame:
    """Titles of each admission in order of their rank; unknown codes read "Unknown"."""
    title = or_default(F.col("long_title"), UNKNOWN)
    return (
        diagnoses.groupBy("subject_id", "hadm_id")
        .agg(ordered_list(title, F.col("seq_num")).alias("complete_diagnosis"))
        .withColumn("diagnosis_count", F.size("complete_diagnosis").cast("bigint"))
    )


def emergency_list(diagnoses: DataFrame, order: Sequence[str]) -> DataFrame:
    """Titles of each emergency stay in the given order, with the patient of its first row."""
    position = F.struct(*order)
    return (
        diagnoses.groupBy("stay_id")
        .agg(
            ordered_list(F.col("icd_title"), *[F.col(c) for c in order]).alias("complete_diagnosis"),
            F.min_by("subject_id", position).alias("subject_id"),
        )
        .withColumn("diagnosis_count", F.size("complete_diagnosis").cast("bigint"))
    )


def patient_union(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every diagnosis of a patient once, in the spelling it had first.

    ``items`` has one row per mention: subject_id, title and the columns of
    ``order``. Mentions are reduced to one row per patient and name before
    anything is gathered by patient, so a list is never longer than the
    number of different names.
    """
    titled = items.withColumn("title", trimmed(F.col("title"))).where(F.col("title") != "")
    position = F.struct(*[F.col(c) for c in order])
    names = titled.groupBy("subject_id", F.lower("title").alias("_name")).agg(
        F.min(F.struct(position.alias("p"), F.col("title").alias("t"))).alias("_first")
    )
    return names.groupBy("subject_id").agg(
        F.transform(F.array_sort(F.collect_list("_first")), lambda r: r["t"]).alias("all_diagnoses")
    )
