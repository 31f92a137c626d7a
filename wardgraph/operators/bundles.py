"""Facts of one stay and one moment listed together.

A bundle is one output row whose list is the result itself. Lists are sorted
on an explicit key, so they do not depend on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgraph.operators.intervals import JOIN_KEYS


def ordered_list(text: Column, *order: Column) -> Column:
    """Aggregate: texts as a list in the given order."""
    rows = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], text.alias("text"))
    return F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["text"])


def bundle(
    assigned: DataFrame,
    keys: Sequence[str],
    text: Column,
    order: Sequence[Column],
    items: str,
    count: str,
    flagged: tuple[Column, str, str] | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per ``keys`` with the ordered texts and their number.

    Texts of equal ``order``, or all without one, are ordered by themselves.
    ``flagged`` is (condition, list name, count name) for a second list of the
    rows that meet a condition. The keys of the interval join stay among the
    grouping keys: they follow from stay and time, so the groups are the same
    and the partitioning of the join serves for the grouping.
    """
    by = [k for k in JOIN_KEYS if k in assigned.columns and k not in keys]
    parts = {f"o{i}": c for i, c in enumerate(order)}
    flag = [flagged[0].alias("flag")] if flagged else []
    row = F.struct(*[c.alias(n) for n, c in parts.items()], text.alias("text"), *flag)
    grouped = assigned.groupBy(*by, *keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"), *extra)
    out = grouped.withColumns(
        {
            items: F.transform("_rows", lambda r: r["text"]),
            count: F.size("_rows").cast("bigint"),
        }
    )
    if flagged:
        _, name, n = flagged
        hits = F.filter("_rows", lambda r: r["flag"])
        out = out.withColumns({name: F.transform(hits, lambda r: r["text"]), n: F.size(hits).cast("bigint")})
    return out.drop("_rows", *[k for k in by if k.startswith("_")])


def list_by_stay(rows: DataFrame, text: Column, order: Sequence[Column], time: str) -> DataFrame:
    """Per stay_id: the ordered texts, their number, and the time of the first row.

    Rows without a text stay out of the list but can give the time.
    """
    position = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    row = F.when(text.isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], text.alias("text")))
    return (
        rows.groupBy("stay_id")
        .agg(
            F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"]).alias("medications"),
            F.min_by(F.col(time), position).alias("charttime"),
        )
        .withColumn("medication_count", F.size("medications").cast("bigint"))
    )


def unassigned_counts(unassigned: DataFrame) -> DataFrame:
    """Unassigned facts per admission; facts without an admission are left out."""
    known = unassigned.where(F.col("hadm_id").isNotNull())
    return known.groupBy("hadm_id").agg(F.count(F.lit(1)).alias("unassigned"))


def keep_first(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per non-null ``key``; rows without a key are all kept. Rows of equal
    ``order`` are told apart by all their columns, so a rerun keeps the same row.

    The winner is found by an aggregate that combines before the shuffle, so a
    key with very many repeats costs no more than any other.
    """
    whole = F.struct(*rows.columns)
    rest = [f.name for f in rows.schema.fields if f.name not in order and "map<" not in f.dataType.simpleString()]
    position = F.struct(*order, *rest)
    firsts = (
        rows.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min_by(whole, position).alias("_row"))
        .select("_row.*")
    )
    return firsts.unionByName(rows.where(F.col(key).isNull()))


def antibiogram(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Organism, antibiotic and sensitivity rows of the groups that are sensitivity tables.

    A group is one when it has more than three findings and its first three
    (in order of text) all contain ``|``. The first three come from an
    aggregate of bounded size, so no group is gathered whole.
    """
    from wardgraph.functions.text import parse_sensitivity

    heads = (
        findings.groupBy(*keys, "finding")
        .agg(F.count(F.lit(1)).alias("_same"))
        .groupBy(*keys)
        .agg(
            F.sum("_same").alias("_n"),
            F.min("finding").alias("_first"),
            # Findings without the mark that may be among the first three.
            F.min_by("finding", F.when(~F.contains("finding", F.lit("|")), F.col("finding"))).alias("_plain"),
        )
    )
    marked = findings.join(heads.where(F.col("_n") > 3), list(keys))
    before_plain = marked.where(F.col("finding") < F.col("_plain")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_before"))
    tables = heads.where(F.col("_n") > 3).join(before_plain, list(keys), "left").where(
        F.col("_plain").isNull() | (F.coalesce("_before", F.lit(0)) >= 3)
    )
    parsed = parse_sensitivity(F.col("finding"))
    rows = findings.join(tables.select(*keys, "_first"), list(keys)).withColumn("_p", parsed)
    return rows.where(F.col("_p.antibiotic").isNotNull()).select(
        *keys,
        parse_sensitivity(F.col("_first"))["organism"].alias("organism"),
        F.col("_p.antibiotic").alias("antibiotic"),
        F.col("_p.sensitivity").alias("sensitivity"),
    )
