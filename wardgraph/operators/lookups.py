"""Equi joins that describe or place facts.

No side is hinted for broadcast: Spark broadcasts a dictionary while its
measured size stays under ``spark.sql.autoBroadcastJoinThreshold`` and sorts
and merges beyond it, splitting hot codes at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.operators.flow import event_id


def with_items(facts: DataFrame, items: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Facts with columns of the item dictionary; unknown items keep nulls."""
    return facts.join(items.select("itemid", *columns), "itemid", "left")


def with_titles(coded: DataFrame, titles: DataFrame) -> DataFrame:
    """Coded rows with the title of (code, version); codes are text on both sides."""
    return coded.join(titles.select("icd_code", "icd_version", "long_title"), ["icd_code", "icd_version"], "left")


def tasks(procedure_events: DataFrame) -> DataFrame:
    return procedure_events.where(F.col("ordercategorydescription") == "Task")


def on_icu_stay(events: DataFrame, icustays: DataFrame) -> DataFrame:
    """Events of an intensive-care stay by its identifier."""
    stays = icustays.select("stay_id", "subject_id", "hadm_id", event_id(F.col("stay_id")).alias("event_id"))
    return events.join(stays, "stay_id")


def on_ed_stay(rows: DataFrame, edstays: DataFrame) -> DataFrame:
    """Rows of an emergency stay; rows without a known stay are dropped."""
    return rows.join(edstays.select("stay_id", "subject_id"), "stay_id")


def on_admission(facts: DataFrame, admissions: DataFrame) -> DataFrame:
    """Facts whose admission and patient both agree with a known admission."""
    known = admissions.select("hadm_id", "subject_id")
    return facts.where(F.col("hadm_id").isNotNull()).join(known, ["hadm_id", "subject_id"], "left_semi")


def identified(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows that have all the given identifiers."""
    for c in ids:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def nonblank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose ``column`` is more than white space, with it trimmed as ``name``."""
    return rows.withColumn(name, F.trim(F.col(column))).where(F.col(name) != "")
