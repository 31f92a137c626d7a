"""Shapes of the plans that matter at scale."""

import re

import pytest

import __spark_entry__ as entry
from wardgraph.operators import intervals
from wardgraph.suite import facts
from wardgraph.suite.views import Views

SF = "/root/testdata/sf0.001"
NAMES = [
    "flagship", "w1_ed_sequence", "w6_flow_edges", "w7_first_event", "w11_dedup_keep_first", "jn2_service_at_transfer",
    "jn4_stay_interval_join_nullsafe", "jn6_icd_date_interval", "jn8_orphan_anti_join", "jn9_asof_next_ed", "a5_time_bundle_proc",
    "a9_patient_dx_union", "a12_unassigned_by_admission", "f3_cohort_filter", "u1_upsert_by_key", "j6_patient_summary_facts",
    "jn17_self_cross_similarity", "v3_similar_patients",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_bundling_reuses_the_partitioning_of_the_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(facts.lab_bundles(Views(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = text[: text.index("SortMergeJoin")]
    assert "collect_list" in above and "Exchange" not in above
    assert re.search(r"Exchange hashpartitioning\(subject_id#\d+L, _hadm#\d+, _day#\d+", text)


def test_scans_are_pruned_and_filtered(spark):
    v = Views(spark, SF)
    text = plan(v.prescriptions.where("l_suppkey > 3").select("l_orderkey", "l_suppkey"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(l_suppkey,3\)", text)
    assert "l_tax" not in text and "l_extendedprice" not in text


def test_similarity_takes_the_best_of_each_task(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["v3_similar_patients"](spark, SF))


def test_hot_patient_is_many_join_keys(spark):
    """A third of all facts on one patient still spreads over the days they happened on."""
    days = spark.range(0, 300).selectExpr(
        "1L as subject_id", "10L as hadm_id", "id", "cast(timestampadd(HOUR, cast(id * 5 as int), timestamp'2150-01-01') as timestamp_ntz) as t"
    )
    keyed = intervals.facts_by_day(days, "t")
    biggest = keyed.groupBy(*intervals.JOIN_KEYS).count().agg({"count": "max"}).head()[0]
    assert biggest <= 5


def test_dated_facts_are_shuffled_once_more_at_most(spark):
    """Facts that were joined by their admission meet the stays without another shuffle; stays are not laid out over days."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = Views(spark, SF)
        text = plan(intervals.assign_dates(v.icd_procedures, v.admission_windows, "chartdate"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("lineitem.parquet]") == 1 and text.count("Exchange hashpartitioning") == 3
    assert "Generate" not in text


def test_dated_facts_of_repeated_and_unknown_keys(spark):
    stays = spark.sql(
        """SELECT * FROM VALUES (1L, 10L, 'a', 'U', timestamp_ntz'2150-01-01 08:00:00', timestamp_ntz'2150-01-03 08:00:00'),
           (1L, 10L, 'a', 'U', timestamp_ntz'2150-01-01 08:00:00', timestamp_ntz'2150-01-03 08:00:00'),
           (2L, 10L, 'b', 'U', timestamp_ntz'2150-01-01 08:00:00', CAST(NULL AS timestamp_ntz)),
           (CAST(NULL AS bigint), 10L, 'c', 'U', CAST(NULL AS timestamp_ntz), CAST(NULL AS timestamp_ntz)),
           (1L, 10L, 'd', 'U', timestamp_ntz'2150-01-03 08:00:00', timestamp_ntz'2150-01-01 08:00:00'),
           (1L, CAST(NULL AS bigint), 'e', 'U', CAST(NULL AS timestamp_ntz), CAST(NULL AS timestamp_ntz))
           AS t(subject_id, hadm_id, event_id, label, intime, outtime)"""
    )
    facts_ = spark.sql(
        """SELECT * FROM VALUES (1L, 10L, date'2150-01-01'), (1L, 10L, date'2150-01-04'), (2L, 10L, date'2140-01-01'),
           (CAST(NULL AS bigint), 10L, date'2150-01-02'), (1L, CAST(NULL AS bigint), date'2150-01-02'), (1L, 10L, CAST(NULL AS date))
           AS t(subject_id, hadm_id, d)"""
    )
    got = intervals.assign_dates(facts_, stays, "d")
    assert got.columns == ["subject_id", "hadm_id", "event_id", "label", "intime", "outtime", "d"]
    assert sorted((r.event_id, str(r.d)) for r in got.collect()) == [("a", "2150-01-01"), ("a", "2150-01-01"), ("b", "2140-01-01")]
    strict = intervals.assign_dates(facts_, stays, "d", strict=True)
    assert [(r.event_id, str(r.d)) for r in strict.collect()] == [("b", "2140-01-01")]
