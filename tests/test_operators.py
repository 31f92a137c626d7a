"""Edge cases of single operators on hand-made rows."""

from datetime import date, datetime

from pyspark.sql import functions as F

from wardgraph.functions import clinical, numbers, text, times
from wardgraph.operators import bundles, diagnoses, flow, intervals, similarity, tracker, upsert
from wardgraph.plans import cohort


def at(hour, minute=0, day=1):
    return datetime(2150, 1, day, hour, minute)


def one(spark, column, rows="x int", data=((1,),)):
    return spark.createDataFrame(list(data), rows).select(column.alias("v")).head()["v"]


TRANSFERS = "subject_id bigint, hadm_id bigint, transfer_id bigint, eventtype string, careunit string, intime timestamp_ntz, outtime timestamp_ntz"
STAYS = "subject_id bigint, hadm_id bigint, event_id string, label string, intime timestamp_ntz, outtime timestamp_ntz"


def merged(spark, rows):
    stays = flow.continuous_stays(spark.createDataFrame(rows, TRANSFERS))
    return [tuple(r) for r in stays.orderBy("intime").select("event_id", "careunit", "intime", "outtime").collect()]


def test_touching_stays_in_one_unit_merge(spark):
    rows = [
        (1, 9, 1, "admit", "A", at(10), at(12)),
        (1, 9, 2, "transfer", "A", at(12), at(15)),
        (1, 9, 3, "transfer", "B", at(15), at(16)),
        (1, 9, 4, "transfer", "A", at(16), at(18)),
    ]
    assert merged(spark, rows) == [
        ("1", "A", at(10), at(15)), ("3", "B", at(15), at(16)), ("4", "A", at(16), at(18)),
    ]
    stays = flow.continuous_stays(spark.createDataFrame(rows, TRANSFERS))
    edges = flow.flow_edges(flow.with_previous_stay(stays)).collect()
    assert {(e.src_key, e.rel, e.dst_key) for e in edges} == {
        ("1", "LED_TO_UNIT_ADMISSION", "3"), ("3", "LED_TO_UNIT_ADMISSION", "4"),
    }


def test_a_gap_or_an_emergency_row_breaks_a_run(spark):
    gap = [(1, 9, 1, "admit", "A", at(10), at(12)), (1, 9, 2, "transfer", "A", at(12, 1), at(15))]
    assert len(merged(spark, gap)) == 2
    ed = [
        (1, 9, 1, "admit", "A", at(10), at(12)),
        (1, 9, 2, "ed", "A", at(12), at(13)),
        (1, 9, 3, "transfer", "A", at(13), at(14)),
    ]
    assert len(merged(spark, ed)) == 3


def test_runs_cross_midnight(spark):
    rows = [(1, 9, i, "transfer", "A", at(20, day=i), at(20, day=i + 1)) for i in range(1, 6)]
    assert merged(spark, rows) == [("1", "A", at(20, day=1), at(20, day=6))]


def test_no_edge_leads_into_an_emergency_visit(spark):
    rows = [
        (1, 9, 1, "ed", None, at(8), at(10)),
        (1, 9, 2, "admit", "A", at(10), at(12)),
        (1, 9, 3, "discharge", None, at(12), None),
    ]
    stays = flow.continuous_stays(spark.createDataFrame(rows, TRANSFERS))
    edges = flow.flow_edges(flow.with_previous_stay(stays)).collect()
    assert {(e.src_label, e.rel, e.dst_label) for e in edges} == {
        ("EmergencyDepartment", "LED_TO_UNIT_ADMISSION", "UnitAdmission"),
        ("UnitAdmission", "LED_TO_DISCHARGE", "Discharge"),
    }


def test_admission_timing(spark):
    rows = [
        ("ed", at(10), at(12), at(11)), ("ed", at(10), at(12), at(13)), ("ed", at(10), at(12), at(9)),
        ("ed", at(10), None, at(11)), ("admit", at(10), at(12), at(13)), ("ed", at(10), at(12), None),
    ]
    df = spark.createDataFrame(rows, "t string, i timestamp_ntz, o timestamp_ntz, a timestamp_ntz")
    got = [r.v for r in df.select(flow.admission_timing(F.col("t"), F.col("i"), F.col("o"), F.col("a")).alias("v")).collect()]
    assert got == [
        "LED_TO_ADMISSION_DURING_STAY", "LED_TO_ADMISSION_AFTER_DISCHARGE", "LED_TO_ADMISSION", "LED_TO_ADMISSION",
        "LED_TO_ADMISSION", None,
    ]


def test_a_fact_on_a_shared_boundary_belongs_to_both_stays(spark):
    stays = spark.createDataFrame([(1, 9, "a", "U", at(10), at(12)), (1, 9, "b", "U", at(12), at(14))], STAYS)
    facts = spark.createDataFrame(
        [(1, 9, 1, at(12)), (1, None, 2, at(11)), (2, 9, 3, at(11))], "subject_id bigint, hadm_id bigint, id int, t timestamp_ntz"
    )
    got = intervals.assign(facts, stays, "t").select("id", "event_id").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (1, "b")]
    assert {r.id for r in intervals.unassigned(facts, stays, "t").collect()} == {2, 3}


def test_stays_over_many_days(spark):
    stays = spark.createDataFrame([(1, 9, "a", "U", datetime(2150, 1, 1), datetime(2153, 1, 1))], STAYS)
    facts = spark.createDataFrame(
        [(1, 9, 1, datetime(2152, 6, 1, 3)), (1, 9, 2, datetime(2153, 1, 1)), (1, 9, 3, datetime(2153, 1, 1, 0, 0, 1))],
        "subject_id bigint, hadm_id bigint, id int, t timestamp_ntz",
    )
    assert {r.id for r in intervals.assign(facts, stays, "t").collect()} == {1, 2}


def test_null_admissions_match_null_admissions_only(spark):
    stays = spark.createDataFrame([(1, None, "ed", "E", at(10), at(12))], STAYS)
    facts = spark.createDataFrame([(1, None, 1, at(11)), (1, 7, 2, at(11))], "subject_id bigint, hadm_id bigint, id int, t timestamp_ntz")
    assert [r.id for r in intervals.assign(facts, stays, "t", null_safe=True).collect()] == [1]
    assert intervals.assign(facts, stays, "t").count() == 0


def test_dated_facts(spark):
    stays = spark.createDataFrame(
        [(1, 9, "open", "U", at(10), None), (1, 8, "closed", "U", at(10, day=2), at(12, day=3))], STAYS
    )
    facts = spark.createDataFrame(
        [(1, 9, date(2150, 5, 5)), (1, 8, date(2150, 1, 2)), (1, 8, date(2150, 1, 4))], "subject_id bigint, hadm_id bigint, d date"
    )
    got = {(r.event_id, r.d) for r in intervals.assign_dates(facts, stays, "d").collect()}
    assert got == {("open", date(2150, 5, 5)), ("closed", date(2150, 1, 2))}
    strict = {(r.event_id, r.d) for r in intervals.assign_dates(facts, stays, "d", strict=True).collect()}
    assert strict == {("open", date(2150, 5, 5))}
    left = intervals.not_attached(facts, intervals.assign_dates(facts, stays, "d"), "d").collect()
    assert [r.d for r in left] == [date(2150, 1, 4)]


def test_next_visit_is_strictly_later(spark):
    columns = "subject_id bigint, event_id string, intime timestamp_ntz"
    discharges = spark.createDataFrame([(1, "d", at(12)), (2, "e", at(12))], columns)
    visits = spark.createDataFrame([(1, "same", at(12)), (1, "next", at(13)), (1, "far", at(13, day=9))], columns)
    got = flow.next_ed_visit(discharges, visits).collect()
    assert [(r.discharge_id, r.ed_event_id, r.gap) for r in got] == [("d", "next", "0 days 1 hours 0 minutes")]


def test_dedup_keeps_first_and_all_without_key(spark):
    rows = spark.createDataFrame([("x", 2), ("x", 1), (None, 3), (None, 4)], "poe_id string, ord int")
    got = bundles.keep_first(rows, "poe_id", ["ord"]).collect()
    assert sorted((r.poe_id or "", r.ord) for r in got) == [("", 3), ("", 4), ("x", 1)]


def test_diagnoses_keep_the_first_spelling(spark):
    rows = spark.createDataFrame(
        [(1, "Sepsis", 1), (1, "sepsis ", 2), (1, " ", 3), (1, "HTN", 4)], "subject_id bigint, title string, ord int"
    )
    assert diagnoses.patient_union(rows, ["ord"]).head()["all_diagnoses"] == ["Sepsis", "HTN"]


def test_abnormal_needs_all_three(spark):
    df = spark.createDataFrame([(5.0, None, None), (5.0, 6.0, 7.0), (6.0, 6.0, 7.0), (None, 1.0, 2.0)], "v double, a double, b double")
    got = [r.x for r in df.select(numbers.out_of_range(F.col("v"), F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [False, True, False, False]


def test_clinical_lines(spark):
    lab = clinical.lab_result(
        F.lit("PTT"), F.lit(40.6), F.lit("sec"), F.lit(25.0), F.lit(35.0), F.lit("abnormal"), F.lit("Blood"), F.lit("Blood Gas")
    )
    assert one(spark, lab) == "PTT=40.6sec (ref: 25.0-35.0) [abnormal] Blood, Blood Gas"
    null, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    assert one(spark, clinical.lab_result(null, none, F.lit("mg"), none, none, null, null, null)) == "Unknown=N/A"
    rx = clinical.medicine(F.lit("GuaiFENesin"), F.lit("5-10"), F.lit("mL"), F.lit("PO/NG"), F.lit(6.0))
    assert one(spark, rx) == "GuaiFENesin 5-10 mL PO/NG 6x/day"
    micro = clinical.micro_result(F.lit("BLOOD"), F.lit("CULTURE"), F.lit("E. COLI"), F.lit("AMPICILLIN"), F.lit(8.0), F.lit("R"), null)
    assert one(spark, micro) == "BLOOD: CULTURE → E. COLI | AMPICILLIN=8.0(R)"
    assert one(spark, clinical.micro_result(F.lit("U"), F.lit("C"), null, null, none, null, null)) == "U: C"
    chart = clinical.chart_measurement(F.lit("HR"), null, F.lit(80.0), null, F.lit("bpm"), F.lit("Numeric"), F.lit(60.0), F.lit(100.0))
    assert one(spark, chart) == "HR with value 80.0bpm (normal range: 60.0-100.0)"
    proc = clinical.icu_procedure(F.lit("Vent"), F.lit("Task"), F.lit("Tube"), F.lit(2.0), F.lit("h"), F.lit(1.0), none)
    assert one(spark, proc) == "Vent (Task) - Tube with value 2.0h (Ref: 1.0 - ∞)"


def test_large_and_small_numbers_stay_plain(spark):
    assert one(spark, numbers.float_text(F.lit(10000000.0))) == "10000000.0"
    assert one(spark, numbers.float_text(F.lit(0.0001))) == "0.0001"
    assert one(spark, numbers.short_text(F.lit(100.0))) == "100"


def test_complaints(spark):
    old = F.lit("Chest pain, SOB")
    assert one(spark, text.merge_complaint(old, F.lit("sob"))) == "Chest pain, SOB"
    assert one(spark, text.merge_complaint(old, F.lit("fever"))) == "Chest pain, SOB, fever"
    assert one(spark, text.merge_complaint(old, F.lit(""))) == "Chest pain, SOB"
    assert one(spark, text.merge_complaint(F.lit(None).cast("string"), F.lit("fever"))) == "fever"


def test_allergies_and_vitals(spark):
    assert one(spark, text.allergies(F.lit("Penicillin, penicillin and Sulfa; NKDA"))) == ["Penicillin", "Sulfa"]
    assert one(spark, text.allergies(F.lit(" None "))) == []
    assert one(spark, text.vitals_map(F.lit("Heart Rate: 80, junk, BP: 1/2"))) == {"Heart_Rate": "80", "BP": "1/2"}
    assert one(spark, text.vitals_map(F.lit("a: 1, a: 2"))) == {"a": "2"}


def test_periods(spark):
    start, end = F.lit(datetime(2150, 1, 1)).cast("timestamp_ntz"), F.lit(datetime(2150, 1, 2, 3, 4, 5)).cast("timestamp_ntz")
    assert one(spark, times.period_string(start, end)) == "1 days 3 hours 4 minutes"
    assert one(spark, times.period_string(end, start)) == "-2 days 20 hours 55 minutes"
    assert one(spark, times.gap_string(start, end)) == "1 day, 3 hours, 4 minutes"
    assert one(spark, times.gap_string(start, start)) == "less than a minute"
    assert one(spark, times.display_ts(end)) == "January 02, 2150 at 03:04 AM"
    assert one(spark, times.parse_ts(F.lit("zz"))) is None
    got = spark.range(1, 25).select(times.ordinal(F.col("id")).alias("o")).collect()
    assert [r.o for r in got][10:13] == ["11th", "12th", "13th"] and got[0].o == "1st" and got[21].o == "22nd"


def test_stop_words(spark):
    assert one(spark, text.remove_stop_words(F.lit("Patient: the history of HTN | and more"))) == "Patient : history HTN |"
    assert one(spark, text.diagnosis_query_text(F.lit("the flu, HTN;\nold MI"))) == "flu | HTN | old MI"


def test_latest_status(spark):
    columns = "subject_id bigint, script_name string, processed_at timestamp_ntz, status string, seq bigint"
    log = spark.createDataFrame(
        [(1, "a", at(1), "success", 1), (1, "a", at(2), "failed", 2), (2, "a", at(1), "failed", 1), (2, "a", at(1), "success", 2)], columns
    )
    assert [r.subject_id for r in tracker.done(log, "a").collect()] == [2]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "old", "keep"), (None, "n", "keep")], "k bigint, name string, other string")
    source = spark.createDataFrame([(1, "new", "lost"), (2, "two", "made"), (None, "m", "lost")], "k bigint, name string, other string")
    once = upsert.upsert(target, source, ["k"], on_match=["name"])
    expected = {(1, "new", "keep"), (2, "two", "made"), (None, "m", "keep")}
    assert set(map(tuple, once.collect())) == expected
    assert set(map(tuple, upsert.upsert(once, source, ["k"], on_match=["name"]).collect())) == expected


def test_similarity(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "subject_id bigint, vector array<float>")
    got = similarity.patients(vectors, 0, 3).collect()
    # 1 points the same way, 4 has another length, 5 has no direction.
    assert [(r.subject_id, round(r.score, 4)) for r in got] == [(2, 0.7071), (3, 0.0)]


def test_cohort(spark):
    listed = spark.createDataFrame([("1",), ("1",), (None,), ("x",)], "subject_id string")
    ids = cohort.ids(listed)
    assert [r.subject_id for r in ids.collect()] == [1]
    adm = spark.createDataFrame([(1, 10), (2, 20), (1, None)], "subject_id bigint, hadm_id bigint")
    hadm = cohort.admissions_of(ids, adm)
    assert [r.hadm_id for r in hadm.collect()] == [10]
    assert cohort.restrict(adm, ids, hadm).count() == 1
    assert cohort.restrict(adm, ids, hadm, keep_null_hadm=True).count() == 2
    assert cohort.restrict(adm.select("subject_id"), ids, hadm).count() == 2
    words = spark.createDataFrame([("a",)], "code string")
    assert cohort.restrict(words, ids, hadm).count() == 1
