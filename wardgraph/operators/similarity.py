"""Nearest patients by cosine.

The reference vector is one row; it enters the plan as a scalar subquery, so
the other vectors are scanned once and only the best k leave each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgraph.functions.vectors import cosine

# Decimals at which two vectors count as the same.
SAME = 12


def scored(vectors: DataFrame, reference: Column) -> DataFrame:
    """Vectors as long as the reference, with their cosine to it."""
    same = vectors.withColumn("_ref", reference).where(F.size("vector") == F.size("_ref"))
    return same.withColumn("score", cosine(F.col("vector"), F.col("_ref"))).drop("_ref").where(
        F.col("score").isNotNull()
    )


def vector_of(vectors: DataFrame, subject_id: int) -> Column:
    return vectors.where(F.col("subject_id") == subject_id).select("vector").scalar()


def _best(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "subject_id").limit(k)


def others(vectors: DataFrame, subject_id: int) -> DataFrame:
    """Every other patient with a vector of the same length, with the score."""
    return scored(vectors.where(F.col("subject_id") != subject_id), vector_of(vectors, subject_id))


def patients(vectors: DataFrame, subject_id: int, k: int = 20) -> DataFrame:
    """The k most similar other patients; exact twins (score 1) are left out."""
    return _best(others(vectors, subject_id).where(F.round("score", SAME) < 1.0), k)


def by_index(vectors: DataFrame, subject_id: int, k: int = 20) -> DataFrame:
    """Index search: the k nearest with the patient among them, then without it."""
    nearest = _best(scored(vectors, vector_of(vectors, subject_id)), k)
    return nearest.where(F.col("subject_id") != subject_id)


def by_vector(vectors: DataFrame, reference: Column, k: int = 20, drop_same: bool = True) -> DataFrame:
    """The k patients nearest to a query vector."""
    rows = scored(vectors, reference)
    return _best(rows.where(F.round("score", SAME) < 1.0) if drop_same else rows, k)


def by_diagnosis(stored: DataFrame, query_text: DataFrame, embedder, k: int = 20) -> DataFrame:
    """The k patients whose diagnoses are nearest to a free text.

    ``stored`` has subject_id and vector, and keeps what else it has;
    ``query_text`` is one row with the column ``text``.
    """
    from wardgraph.functions.text import diagnosis_query_text

    reference = query_text.select(embedder(diagnosis_query_text(F.col("text"))).alias("v")).scalar()
    return by_vector(stored, reference, k)


def score_stats(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("score").alias("found"), F.max("score").alias("best"), F.min("score").alias("worst")
    )
