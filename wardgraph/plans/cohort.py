"""Cutting the hospital tables down to a cohort of patients."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgraph.session import written
from wardgraph.sources import files, schemas


def ids(listed: DataFrame, column: str = "subject_id") -> DataFrame:
    """Distinct patient numbers of a list that may hold blanks and repeats."""
    number = F.col(column).try_cast("bigint").alias("subject_id")
    return listed.select(number).where(F.col("subject_id").isNotNull()).distinct()


def admissions_of(cohort: DataFrame, admissions: DataFrame) -> DataFrame:
    """Distinct admissions of the cohort."""
    mine = admissions.join(cohort, "subject_id", "left_semi")
    return mine.where(F.col("hadm_id").isNotNull()).select("hadm_id").distinct()


def restrict(
    table: DataFrame, cohort: DataFrame, hadm_ids: DataFrame, keep_null_hadm: bool = False
) -> DataFrame:
    """Rows of the cohort: by admission where the table has one, else by patient.

    A table with neither is a dictionary and is kept whole. Rows without an
    admission are dropped from a table that has admissions, unless
    ``keep_null_hadm`` keeps those of the cohort's patients.
    """
    if "hadm_id" in table.columns:
        kept = table.join(hadm_ids, "hadm_id", "left_semi")
        if keep_null_hadm and "subject_id" in table.columns:
            alone = table.where(F.col("hadm_id").isNull()).join(cohort, "subject_id", "left_semi")
            kept = kept.unionByName(alone.select(*kept.columns))
        return kept.select(*table.columns)
    if "subject_id" in table.columns:
        return table.join(cohort, "subject_id", "left_semi").select(*table.columns)
    return table


def active_patients(patients: DataFrame, admissions: DataFrame, edstays: DataFrame) -> DataFrame:
    """Patients with at least one admission or emergency stay."""
    seen = admissions.select("subject_id").union(edstays.select("subject_id"))
    return patients.join(seen, "subject_id", "left_semi")


def cut(
    spark: SparkSession,
    source: str,
    target: str,
    cohort: DataFrame,
    modules: Iterable[str] = tuple(schemas.CATALOG),
    keep_null_hadm: bool = False,
) -> list[str]:
    """Read every table of the catalogue from CSV, cut it and write it as Parquet.

    Tables are found at ``source/module/table.csv``; missing ones are left
    out. Returns the names of the tables written.
    """
    # Both lists are read once for every table of the catalogue.
    chosen = written(ids(cohort), "cohort")
    read_admissions = lambda: files.csv_scan(
        spark, f"{source}/hosp/admissions.csv", schemas.HOSP["admissions"]
    )
    hadm_ids = written(
        admissions_of(chosen, files.optional(spark, read_admissions, schemas.HOSP["admissions"])), "admissions"
    )
    done = []
    for module in modules:
        for name in schemas.CATALOG[module]:
            path = f"{source}/{module}/{name}.csv"
            declared = schemas.schema(module, name)
            if module == "note":
                read = lambda p=path, s=declared: files.notes_csv_scan(spark, p, s)
            else:
                read = lambda p=path, s=declared: files.csv_scan(spark, p, s)
            try:
                table = read()
            except files.AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            files.replace(restrict(table, chosen, hadm_ids, keep_null_hadm), f"{target}/{module}/{name}")
            done.append(f"{module}/{name}")
    return done
