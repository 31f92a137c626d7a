"""Facts assigned to the stays they happened in.

Both ends of a stay count, so a fact on the boundary of two stays, or in
overlapping ones, belongs to each of them. The join key holds the day besides
the patient and the admission: a stay is laid out over its days, a fact has
one. That keeps a patient with very many facts spread over many tasks and
compares a fact only with stays of its own day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "_day"
HADM = "_hadm"
JOIN_KEYS = ["subject_id", HADM, DAY]

STAY_COLUMNS = ["event_id", "label", "intime", "outtime"]


def _hadm_key(null_safe: bool) -> Column:
    h = F.col("hadm_id").cast("string")
    return F.coalesce(h, F.lit("none")) if null_safe else h


def stays_by_day(stays: DataFrame, null_safe: bool = False) -> DataFrame:
    """One row per stay and day; stays without both times are left out."""
    whole = stays.where(F.col("intime").isNotNull() & (F.col("outtime") >= F.col("intime")))
    return whole.select(
        "subject_id",
        _hadm_key(null_safe).alias(HADM),
        *STAY_COLUMNS,
        F.explode(F.sequence(F.to_date("intime"), F.to_date("outtime"))).alias(DAY),
    )


def facts_by_day(facts: DataFrame, time: str, null_safe: bool = False) -> DataFrame:
    keyed = facts.where(F.col(time).isNotNull())
    return keyed.withColumns({HADM: _hadm_key(null_safe), DAY: F.to_date(time)})


def assign(facts: DataFrame, stays: DataFrame, time: str, null_safe: bool = False) -> DataFrame:
    """Facts with the stays they fall into, one row per pair.

    Patient and admission must agree. With ``null_safe`` facts without an
    admission match stays without one; otherwise they match nothing.

    The result is still partitioned by ``JOIN_KEYS``; grouping by these and
    the stay (see ``bundles``) needs no further shuffle.
    """
    f, s = facts_by_day(facts, time, null_safe), stays_by_day(stays, null_safe)
    pairs = f.join(s, JOIN_KEYS)
    return pairs.where(F.col(time).between(F.col("intime"), F.col("outtime")))


def unassigned(facts: DataFrame, stays: DataFrame, time: str, null_safe: bool = False) -> DataFrame:
    """Facts that fall into no stay."""
    f = facts.withColumns({HADM: _hadm_key(null_safe), DAY: F.to_date(time)}).alias("f")
    s = stays_by_day(stays, null_safe).alias("s")
    on = [F.col(f"f.{k}") == F.col(f"s.{k}") for k in JOIN_KEYS]
    inside = F.col(f"f.{time}").between(F.col("s.intime"), F.col("s.outtime"))
    for c in on:
        inside = inside & c
    return f.join(s, inside, "left_anti").drop(HADM, DAY)


def assign_dates(facts: DataFrame, stays: DataFrame, date: str, strict: bool = False) -> DataFrame:
    """Dated facts (no time of day) with the stays whose days they fall on.

    A stay that lacks a bound takes every fact of its admission. With
    ``strict`` the date counts as midnight, which leaves out the day of
    arrival.

    Facts and stays meet by admission, once for closed and open stays, and are
    not laid out over days: facts that were joined by their admission before
    stay where they are. A hot admission is split by Spark's handling of skew.
    """
    f = facts.where(F.col(date).isNotNull() & F.col("hadm_id").isNotNull()).alias("f")
    s = stays.where(F.col("hadm_id").isNotNull()).select("subject_id", "hadm_id", *STAY_COLUMNS).alias("s")
    closed = F.col("s.intime").isNotNull() & F.col("s.outtime").isNotNull()
    day = F.col(f"f.{date}")
    inside = (
        day.cast("timestamp_ntz").between(F.col("s.intime"), F.col("s.outtime"))
        if strict
        else day.between(F.to_date("s.intime"), F.to_date("s.outtime")) & (F.col("s.outtime") >= F.col("s.intime"))
    )
    # As a condition, not a key: with the patient as a second key Spark would shuffle the facts again.
    same = F.when(F.col("f.subject_id") == F.col("s.subject_id"), ~closed | inside)
    rest = [F.col(f"f.{c}") for c in facts.columns if c not in ("subject_id", "hadm_id")]
    return s.join(f, (F.col("s.hadm_id") == F.col("f.hadm_id")) & same).select("s.*", *rest)


def not_attached(dated: DataFrame, attached: DataFrame, date: str) -> DataFrame:
    """Dated facts whose (admission, day) has not been attached to a stay."""
    taken = attached.select("hadm_id", F.to_date(date).alias(date)).distinct()
    return dated.join(taken, ["hadm_id", date], "left_anti")
