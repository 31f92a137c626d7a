"""Patient flow: sequences, merged stays, edges, what came first and what next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.functions.times import format_ts
from wardgraph.operators import flow
from wardgraph.suite.registry import query
from wardgraph.suite.sql_views import period, ts
from wardgraph.suite.views import Views


def _text(c: str):
    return F.col(c).cast("string").alias(c)


def _time(c: str):
    return format_ts(F.col(c)).alias(c)


@query(
    "w1_ed_sequence",
    """SELECT subject_id, stay_id, row_number() OVER (PARTITION BY subject_id ORDER BY intime, stay_id) AS ed_seq_num
       FROM edstays""",
)
def w1(v: Views) -> DataFrame:
    return flow.ed_sequence(v.edstays).select("subject_id", "stay_id", "ed_seq_num")


@query(
    "w2_ed_sequence_continued",
    """WITH outside AS (SELECT * FROM transfers t WHERE eventtype = 'ed' AND NOT EXISTS (
            SELECT 1 FROM edstays e WHERE e.subject_id = t.subject_id AND e.stay_id = t.transfer_id)),
       n AS (SELECT subject_id, count(*) AS stays FROM edstays GROUP BY 1)
       SELECT o.subject_id, o.transfer_id,
              row_number() OVER (PARTITION BY o.subject_id ORDER BY intime, transfer_id) + coalesce(stays, 0) AS ed_seq_num
       FROM outside o LEFT JOIN n USING (subject_id)""",
)
def w2(v: Views) -> DataFrame:
    return flow.ed_sequence_continued(v.transfers, v.edstays).select("subject_id", "transfer_id", "ed_seq_num")


@query(
    "w3_admission_sequence",
    """SELECT subject_id, hadm_id,
              row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS admission_seq_num
       FROM admissions""",
)
def w3(v: Views) -> DataFrame:
    return flow.admission_sequence(v.admissions).select("subject_id", "hadm_id", "admission_seq_num")


STAY_SQL = f"""SELECT subject_id, hadm_id, event_id, eventtype, careunit, service_given, merged_rows, label,
              {ts('intime')} AS intime, {ts('outtime')} AS outtime, {period('intime', 'outtime')} AS period
       FROM stays"""


@query("w5_continuous_stay_merge", STAY_SQL)
def w5(v: Views) -> DataFrame:
    return v.stays.select(
        "subject_id", "hadm_id", "event_id", "eventtype", "careunit", "service_given", "merged_rows", "label",
        _time("intime"), _time("outtime"), "period",
    )


PREV_SQL = """SELECT *, lag(event_id) OVER w AS prev_event_id, lag(eventtype) OVER w AS prev_eventtype,
              lag(careunit) OVER w AS prev_careunit, lag(outtime) OVER w AS prev_outtime, lag(label) OVER w AS prev_label
       FROM stays WINDOW w AS (PARTITION BY subject_id, hadm_id ORDER BY intime, event_id::BIGINT)"""


@query(
    "w4_flow_prev",
    f"""WITH linked AS ({PREV_SQL})
        SELECT subject_id, hadm_id, event_id, prev_event_id, prev_eventtype, prev_careunit,
               {ts('prev_outtime')} AS prev_outtime FROM linked""",
)
def w4(v: Views) -> DataFrame:
    return flow.with_previous_stay(v.stays).select(
        "subject_id", "hadm_id", "event_id", "prev_event_id", "prev_eventtype", "prev_careunit", _time("prev_outtime")
    )


@query(
    "w6_flow_edges",
    f"""WITH linked AS ({PREV_SQL})
        SELECT subject_id, prev_label AS src_label, prev_event_id AS src_key,
               CASE eventtype WHEN 'discharge' THEN 'LED_TO_DISCHARGE' ELSE 'LED_TO_UNIT_ADMISSION' END AS rel,
               label AS dst_label, event_id AS dst_key
        FROM linked WHERE prev_event_id IS NOT NULL AND eventtype <> 'ed'""",
)
def w6(v: Views) -> DataFrame:
    return flow.flow_edges(flow.with_previous_stay(v.stays))


FIRST_SQL = """outside AS (SELECT * FROM transfers t WHERE eventtype = 'ed' AND NOT EXISTS (
            SELECT 1 FROM edstays e WHERE e.subject_id = t.subject_id AND e.stay_id = t.transfer_id)),
       openers AS (SELECT subject_id, hadm_id, stay_id AS id, 'ed' AS eventtype, intime, outtime FROM edstays
            UNION ALL SELECT subject_id, hadm_id, transfer_id, 'ed', intime, outtime FROM outside
            UNION ALL SELECT subject_id, hadm_id, transfer_id, eventtype, intime, outtime FROM transfers
                WHERE eventtype IN ('admit', 'transfer')),
       firsts AS (SELECT * FROM openers WHERE hadm_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY subject_id, hadm_id ORDER BY intime, id) = 1)"""


@query(
    "w7_first_event",
    f"""WITH {FIRST_SQL}
        SELECT subject_id, hadm_id, CAST(id AS VARCHAR) AS event_id, eventtype,
               CASE eventtype WHEN 'ed' THEN 'EmergencyDepartment' ELSE 'UnitAdmission' END AS label,
               {ts('intime')} AS intime, {ts('outtime')} AS outtime FROM firsts""",
)
def w7(v: Views) -> DataFrame:
    return flow.first_event(v.edstays, v.transfers).select(
        "subject_id", "hadm_id", "event_id", "eventtype", "label", _time("intime"), _time("outtime")
    )


@query(
    "w8_admission_timing_class",
    f"""WITH {FIRST_SQL}
        SELECT f.subject_id, f.hadm_id, CAST(id AS VARCHAR) AS event_id,
               CASE WHEN eventtype <> 'ed' THEN 'LED_TO_ADMISSION'
                    WHEN admittime >= intime AND admittime <= outtime THEN 'LED_TO_ADMISSION_DURING_STAY'
                    WHEN admittime > outtime THEN 'LED_TO_ADMISSION_AFTER_DISCHARGE'
                    ELSE 'LED_TO_ADMISSION' END AS rel
        FROM firsts f JOIN flow_admissions a ON f.subject_id = a.subject_id AND f.hadm_id = a.hadm_id
        WHERE admittime IS NOT NULL""",
)
def w8(v: Views) -> DataFrame:
    first = flow.first_event(v.edstays, v.transfers)
    return flow.admission_links(first, v.flow_admissions).select("subject_id", "hadm_id", "event_id", "rel")


@query(
    "w10_lookback_careunit",
    """WITH known AS (SELECT *, CASE WHEN careunit <> 'Unknown' THEN careunit END AS unit FROM stays)
       SELECT subject_id, event_id, eventtype,
              CASE WHEN eventtype = 'discharge' THEN coalesce(unit, last_value(unit IGNORE NULLS) OVER (
                        PARTITION BY subject_id ORDER BY intime, event_id::BIGINT
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), careunit)
                   ELSE careunit END AS careunit FROM known""",
)
def w10(v: Views) -> DataFrame:
    line = v.stays.select("subject_id", "event_id", "eventtype", "careunit", "intime")
    return flow.discharge_unit(line).drop("intime")


@query(
    "jn2_service_at_transfer",
    f"""SELECT subject_id, CAST(hadm_id AS VARCHAR) AS hadm_id, transfer_id, eventtype, service_given,
               {ts('intime')} AS intime FROM served""",
)
def jn2(v: Views) -> DataFrame:
    return flow.with_service(v.transfers, v.services).select(
        "subject_id", _text("hadm_id"), "transfer_id", "eventtype", "service_given", _time("intime")
    )


@query(
    "jn9_asof_next_ed",
    f"""WITH visits AS (SELECT DISTINCT subject_id, event_id, intime FROM (
            SELECT subject_id, CAST(stay_id AS VARCHAR) AS event_id, intime FROM edstays
            UNION ALL SELECT subject_id, CAST(transfer_id AS VARCHAR), intime FROM transfers WHERE eventtype = 'ed'))
        SELECT d.subject_id, d.event_id AS discharge_id, v.event_id AS ed_event_id,
               {ts('d.intime')} AS discharge_time, {ts('v.intime')} AS ed_time, {period('d.intime', 'v.intime')} AS gap
        FROM stays d ASOF JOIN visits v ON d.subject_id = v.subject_id AND d.intime < v.intime
        WHERE d.eventtype = 'discharge'""",
)
def jn9(v: Views) -> DataFrame:
    found = flow.next_ed_visit(v.stays.where(F.col("eventtype") == "discharge"), ed_visits(v))
    return found.withColumns({c: format_ts(F.col(c)) for c in ["discharge_time", "ed_time"]})


def ed_visits(v: Views) -> DataFrame:
    """Emergency visits of both sources, each once."""
    stays = v.edstays.select("subject_id", F.col("stay_id").cast("string").alias("event_id"), "intime")
    rows = v.transfers.where(F.col("eventtype") == "ed").select(
        "subject_id", F.col("transfer_id").cast("string").alias("event_id"), "intime"
    )
    return stays.unionByName(rows).distinct()


@query(
    "jn12_relabel_join",
    """SELECT s.subject_id, s.event_id, CASE WHEN i.stay_id IS NOT NULL AND s.label = 'UnitAdmission' THEN 'ICUStay'
              ELSE s.label END AS label, first_careunit, last_careunit, los
       FROM stays s LEFT JOIN icustays i ON s.event_id = CAST(i.stay_id AS VARCHAR)""",
)
def jn12(v: Views) -> DataFrame:
    return flow.relabel_icu(v.stays, v.icustays).select(
        "subject_id", "event_id", "label", "first_careunit", "last_careunit", "los"
    )


@query(
    "jn12_unmatched_icu_stays",
    """SELECT subject_id, stay_id FROM icustays i WHERE NOT EXISTS (
           SELECT 1 FROM stays s WHERE s.event_id = CAST(i.stay_id AS VARCHAR) AND s.label = 'UnitAdmission')""",
)
def jn12_unmatched(v: Views) -> DataFrame:
    return flow.unmatched_icu(v.stays, v.icustays).select("subject_id", "stay_id")


@query("a10_admission_count", "SELECT subject_id, count(*) AS total_number_of_admissions FROM admissions GROUP BY 1")
def a10(v: Views) -> DataFrame:
    return flow.admission_counts(v.admissions)


@query(
    "f12_column_rename_drop",
    f"SELECT subject_id, transfer_id, service_given, careunit, {ts('intime')} AS intime FROM served",
)
def f12(v: Views) -> DataFrame:
    """The service column renamed, the joined-in key dropped."""
    joined = flow.with_service(v.transfers, v.services)
    return joined.drop("hadm_id", "outtime", "value", "k", "eventtype").withColumn("intime", format_ts(F.col("intime")))


@query(
    "f13_case_map",
    """SELECT transfer_id, CASE eventtype WHEN 'ed' THEN 'EmergencyDepartment' WHEN 'discharge' THEN 'Discharge'
              ELSE 'UnitAdmission' END AS label,
              CASE eventtype WHEN 'discharge' THEN 'LED_TO_DISCHARGE' WHEN 'ed' THEN 'LED_TO_ED'
              ELSE 'LED_TO_UNIT_ADMISSION' END AS rel FROM transfers""",
)
def f13(v: Views) -> DataFrame:
    kind = F.col("eventtype")
    return v.transfers.select("transfer_id", flow.event_label(kind).alias("label"), flow.event_edge(kind).alias("rel"))


@query(
    "f14_event_name",
    """SELECT transfer_id, CASE eventtype WHEN 'discharge' THEN 'Discharge' WHEN 'ed' THEN 'EmergencyDepartment'
              ELSE coalesce(careunit, 'Unknown') END AS name FROM transfers""",
)
def f14(v: Views) -> DataFrame:
    unit = flow.or_default(F.col("careunit"), flow.UNKNOWN)
    return v.transfers.select("transfer_id", flow.event_name(F.col("eventtype"), unit).alias("name"))
