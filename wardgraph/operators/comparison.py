"""Two patients side by side, and the facts of one."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.functions.text import normalize


def pair(items: DataFrame, first: int, second: int) -> DataFrame:
    """Items of two patients per category: shared, only the first's, only the second's.

    ``items`` has subject_id, category and item. Names are compared
    normalised. One row per category and item, so nothing is gathered.
    """
    two = items.where(F.col("subject_id").isin(first, second))
    marked = two.groupBy("category", normalize(F.col("item")).alias("item")).agg(
        F.max((F.col("subject_id") == first).cast("int")).alias("a"),
        F.max((F.col("subject_id") == second).cast("int")).alias("b"),
    )
    side = (
        F.when((F.col("a") == 1) & (F.col("b") == 1), "shared")
        .when(F.col("a") == 1, "only_first")
        .otherwise("only_second")
    )
    return marked.where(F.col("item") != "").select("category", "item", side.alias("side"))


def pair_lists(items: DataFrame, first: int, second: int) -> DataFrame:
    """The same as three sorted lists per category."""
    sides = pair(items, first, second)

    def listed(side: str):
        return F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("item")))).alias(side)

    return sides.groupBy("category").agg(listed("shared"), listed("only_first"), listed("only_second"))


def summary(patients: DataFrame, categories: Mapping[str, DataFrame]) -> DataFrame:
    """Per patient: demographics and one sorted list of different items per category.

    The items of all categories are made distinct in one shuffle, which spreads
    a patient over tasks, and listed in a second, whatever the number of categories.
    """
    parts = [
        items.where(F.col("item").isNotNull()).select("subject_id", F.lit(name).alias("category"), F.col("item").cast("string").alias("item"))
        for name, items in categories.items()
    ]
    if not parts:
        return patients
    lists = (
        reduce(DataFrame.unionByName, parts)
        .distinct()
        .groupBy("subject_id")
        .agg(*[F.array_sort(F.collect_list(F.when(F.col("category") == name, F.col("item")))).alias(name) for name in categories])
    )
    none = F.array().cast("array<string>")
    return patients.join(lists, "subject_id", "left").withColumns({name: F.coalesce(F.col(name), none) for name in categories})
