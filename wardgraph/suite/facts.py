"""Facts: dictionary lookups, assignment to stays, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.functions import clinical, numbers
from wardgraph.functions.times import format_ts
from wardgraph.operators import bundles, diagnoses, intervals, lookups
from wardgraph.suite.registry import query
from wardgraph.suite.sql_views import floats, shorts, ts
from wardgraph.suite.views import Views


def _time(c: str):
    return format_ts(F.col(c)).alias(c)


def _joined(c: str):
    return F.array_join(c, "; ").alias(c)


# --- dictionary lookups -------------------------------------------------------


@query(
    "jn1_lookup_join",
    """SELECT labevent_id, l.itemid, label, fluid, category FROM labevents l LEFT JOIN d_items USING (itemid)""",
)
def jn1(v: Views) -> DataFrame:
    return lookups.with_items(v.labevents, v.d_items, ["label", "fluid", "category"]).select(
        "labevent_id", "itemid", "label", "fluid", "category"
    )


@query(
    "jn1_icd_lookup",
    """SELECT i.subject_id, i.hadm_id, i.icd_code, i.icd_version, coalesce(long_title, 'Unknown') AS long_title
       FROM icd_procedures i LEFT JOIN d_icd d ON i.icd_code = d.icd_code AND i.icd_version = d.icd_version""",
)
def jn1_icd(v: Views) -> DataFrame:
    titled = lookups.with_titles(v.icd_procedures, v.d_icd)
    return titled.select(
        "subject_id", "hadm_id", "icd_code", "icd_version",
        clinical.or_default(F.col("long_title"), "Unknown").alias("long_title"),
    )


# --- laboratory ----------------------------------------------------------------

LAB_TEXT = f"""concat_ws(' ', coalesce(label, 'Unknown') || '=' ||
        coalesce({floats('valuenum')} || coalesce(valueuom, ''), 'N/A'),
        '(ref: ' || {floats('ref_range_lower')} || '-' || {floats('ref_range_upper')} || ')',
        '[' || flag || ']', nullif(concat_ws(', ', fluid, category), ''))"""
ABNORMAL = "coalesce(valuenum < ref_range_lower OR valuenum > ref_range_upper, false) AND ref_range_lower IS NOT NULL AND valuenum IS NOT NULL"


def lab_text():
    return clinical.lab_result(
        *[F.col(c) for c in ["label", "valuenum", "valueuom", "ref_range_lower", "ref_range_upper", "flag", "fluid", "category"]]
    )


def abnormal():
    return numbers.out_of_range(F.col("valuenum"), F.col("ref_range_lower"), F.col("ref_range_upper"))


IN_STAY = """l.subject_id = s.subject_id AND l.hadm_id = s.hadm_id
        AND l.charttime BETWEEN s.intime AND s.outtime"""


def lab_facts(v: Views) -> DataFrame:
    return lookups.with_items(v.labevents, v.d_items, ["label", "fluid", "category"])


@query(
    "jn3_stay_interval_join",
    f"""SELECT l.labevent_id, s.event_id, s.label, {ts('l.charttime')} AS charttime
        FROM labevents l JOIN stay_windows s ON {IN_STAY}""",
)
def jn3(v: Views) -> DataFrame:
    return intervals.assign(v.labevents, v.stay_windows, "charttime").select(
        "labevent_id", "event_id", "label", _time("charttime")
    )


LAB_BUNDLES = f"""labs AS (SELECT l.*, label, fluid, category FROM labevents l LEFT JOIN d_items USING (itemid)),
    placed AS (SELECT l.*, s.event_id, {LAB_TEXT.replace('label', 'l.label')} AS text, {ABNORMAL} AS bad
        FROM labs l JOIN stay_windows s ON {IN_STAY}),
    bundled AS (SELECT event_id, hadm_id, subject_id, charttime,
        string_agg(text, '; ' ORDER BY labevent_id) AS lab_results, count(*) AS lab_count,
        coalesce(string_agg(text, '; ' ORDER BY labevent_id) FILTER (bad), '') AS abnormal_results,
        count(*) FILTER (bad) AS abnormal_count
        FROM placed GROUP BY event_id, hadm_id, subject_id, charttime)"""


def lab_bundles(v: Views) -> DataFrame:
    placed = intervals.assign(lab_facts(v).withColumnRenamed("label", "item"), v.stay_windows, "charttime")
    placed = placed.drop("label").withColumnRenamed("item", "label")
    return bundles.bundle(
        placed,
        ["event_id", "hadm_id", "subject_id", "charttime"],
        lab_text(),
        [F.col("labevent_id")],
        "lab_results",
        "lab_count",
        flagged=(abnormal(), "abnormal_results", "abnormal_count"),
    )


@query(
    "a2_time_bundle_lab",
    f"""WITH {LAB_BUNDLES}
        SELECT event_id, hadm_id, subject_id, {ts('charttime')} AS charttime, lab_results, lab_count,
               abnormal_results, abnormal_count FROM bundled""",
)
def a2(v: Views) -> DataFrame:
    return lab_bundles(v).select(
        "event_id", "hadm_id", "subject_id", _time("charttime"), _joined("lab_results"), "lab_count",
        _joined("abnormal_results"), "abnormal_count",
    )


@query(
    "flagship",
    f"""WITH {LAB_BUNDLES}
        SELECT event_id, hadm_id, subject_id, count(*) AS bundles, sum(lab_count)::BIGINT AS labs,
               sum(abnormal_count)::BIGINT AS abnormal, {ts('min(charttime)')} AS first_charttime
        FROM bundled GROUP BY event_id, hadm_id, subject_id
        ORDER BY abnormal DESC, labs DESC, event_id LIMIT 100""",
)
def flagship(v: Views) -> DataFrame:
    """The 100 stays with the most abnormal laboratory results."""
    return (
        lab_bundles(v)
        .groupBy("event_id", "hadm_id", "subject_id")
        .agg(
            F.count(F.lit(1)).alias("bundles"),
            F.sum("lab_count").alias("labs"),
            F.sum("abnormal_count").alias("abnormal"),
            format_ts(F.min("charttime")).alias("first_charttime"),
        )
        .orderBy(F.desc("abnormal"), F.desc("labs"), "event_id")
        .limit(100)
    )


@query(
    "m1_abnormal_flag",
    f"SELECT labevent_id, flag, {ABNORMAL} AS abnormal FROM labevents",
)
def m1(v: Views) -> DataFrame:
    return v.labevents.select("labevent_id", "flag", abnormal().alias("abnormal"))


@query(
    "p2_lab_string",
    f"SELECT labevent_id, {LAB_TEXT} AS text FROM labevents l LEFT JOIN d_items USING (itemid)",
)
def p2(v: Views) -> DataFrame:
    return lab_facts(v).select("labevent_id", lab_text().alias("text"))


# --- prescriptions -------------------------------------------------------------

RX_TEXT = f"""concat_ws(' ', coalesce(drug, 'Unknown'), nullif(trim(concat_ws(' ', dose_val_rx, dose_unit_rx)), ''),
        nullif(route, ''), {shorts('nullif(doses_per_24_hrs, 0)')} || 'x/day')"""


def rx_text():
    return clinical.medicine(
        *[F.col(c) for c in ["drug", "dose_val_rx", "dose_unit_rx", "route", "doses_per_24_hrs"]]
    )


@query("p1_medicine_string", f"SELECT l_orderkey, l_partkey, l_suppkey, {RX_TEXT} AS text FROM prescriptions")
def p1(v: Views) -> DataFrame:
    return v.prescriptions.select("l_orderkey", "l_partkey", "l_suppkey", rx_text().alias("text"))


RX_IN_STAY = """r.subject_id = s.subject_id AND r.hadm_id IS NOT DISTINCT FROM s.hadm_id
        AND r.{t} BETWEEN s.intime AND s.outtime"""


@query(
    "jn4_stay_interval_join_nullsafe",
    f"""SELECT r.l_orderkey, r.l_partkey, r.l_suppkey, s.event_id, r.hadm_id IS NULL AS no_admission,
               {ts('r.starttime')} AS starttime
        FROM prescriptions r JOIN admission_windows s ON {RX_IN_STAY.format(t='starttime')}""",
)
def jn4(v: Views) -> DataFrame:
    placed = intervals.assign(v.prescriptions, v.admission_windows, "starttime", null_safe=True)
    return placed.select(
        "l_orderkey", "l_partkey", "l_suppkey", "event_id", F.col("hadm_id").isNull().alias("no_admission"),
        _time("starttime"),
    )


@query(
    "a1_time_bundle_rx",
    f"""SELECT s.event_id, {ts('r.starttime')} AS starttime, string_agg({RX_TEXT}, '; ' ORDER BY {RX_TEXT}) AS medicines,
               count(*) AS medicine_count
        FROM prescriptions r JOIN admission_windows s ON {RX_IN_STAY.format(t='starttime')}
        GROUP BY s.event_id, r.starttime""",
)
def a1(v: Views) -> DataFrame:
    placed = intervals.assign(v.prescriptions, v.admission_windows, "starttime", null_safe=True)
    made = bundles.bundle(
        placed, ["event_id", "starttime"], rx_text(), [rx_text()], "medicines", "medicine_count"
    )
    return made.select("event_id", _time("starttime"), _joined("medicines"), "medicine_count")


RX_ORDER = ["starttime", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "w11_dedup_keep_first",
    f"""SELECT poe_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM prescriptions
        WHERE poe_id IS NULL
        UNION ALL
        SELECT poe_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
            SELECT *, row_number() OVER (PARTITION BY poe_id ORDER BY {', '.join(RX_ORDER)}) AS n FROM prescriptions
            WHERE poe_id IS NOT NULL) WHERE n = 1""",
)
def w11(v: Views) -> DataFrame:
    kept = bundles.keep_first(v.prescriptions, "poe_id", RX_ORDER)
    return kept.select("poe_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "x3_concat_restore",
    f"""WITH kept AS (SELECT *, row_number() OVER (PARTITION BY poe_id ORDER BY {', '.join(RX_ORDER)}) AS n
            FROM prescriptions)
        SELECT poe_id, subject_id, {ts('starttime')} AS starttime, l_partkey, l_suppkey, l_extendedprice FROM kept
        WHERE poe_id IS NULL OR n = 1 ORDER BY subject_id, starttime, l_partkey, l_suppkey, l_extendedprice""",
)
def x3(v: Views) -> DataFrame:
    """First rows and rows without a key put together again in their old order."""
    kept = bundles.keep_first(v.prescriptions, "poe_id", RX_ORDER)
    return kept.orderBy("subject_id", *RX_ORDER).select(
        "poe_id", "subject_id", _time("starttime"), "l_partkey", "l_suppkey", "l_extendedprice"
    )


@query(
    "a12_unassigned_by_admission",
    f"""SELECT hadm_id, count(*) AS unassigned FROM prescriptions r WHERE hadm_id IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM admission_windows s WHERE {RX_IN_STAY.format(t='starttime')}) GROUP BY hadm_id""",
)
def a12(v: Views) -> DataFrame:
    lost = intervals.unassigned(v.prescriptions, v.admission_windows, "starttime", null_safe=True)
    return bundles.unassigned_counts(lost)


@query(
    "m3_percentage",
    f"""SELECT count(*) AS total, count(*) FILTER (NOT found) AS unassigned,
               round(100.0::DOUBLE * count(*) FILTER (NOT found) / count(*), 2) AS percent
        FROM (SELECT EXISTS (SELECT 1 FROM admission_windows s WHERE {RX_IN_STAY.format(t='starttime')}) AS found
              FROM prescriptions r)""",
)
def m3(v: Views) -> DataFrame:
    """Share of prescriptions that fall into no stay."""
    lost = intervals.unassigned(v.prescriptions, v.admission_windows, "starttime", null_safe=True)
    counts = lost.agg(F.count(F.lit(1)).alias("unassigned")).withColumn("total", F.lit(None).cast("bigint"))
    whole = v.prescriptions.agg(F.count(F.lit(1)).alias("total")).withColumn("unassigned", F.lit(None).cast("bigint"))
    both = counts.unionByName(whole).agg(F.max("total").alias("total"), F.max("unassigned").alias("unassigned"))
    return both.withColumn("percent", numbers.percentage(F.col("unassigned"), F.col("total")))


@query(
    "o3_sample_limit",
    f"""SELECT subject_id, hadm_id, {ts('starttime')} AS starttime, l_partkey FROM prescriptions r
        WHERE hadm_id IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM admission_windows s WHERE {RX_IN_STAY.format(t='starttime')})
        ORDER BY hadm_id, r.starttime, l_partkey, l_suppkey LIMIT 10""",
)
def o3(v: Views) -> DataFrame:
    """First ten unassigned prescriptions."""
    lost = intervals.unassigned(v.prescriptions, v.admission_windows, "starttime", null_safe=True)
    first = lost.where(F.col("hadm_id").isNotNull()).orderBy("hadm_id", "starttime", "l_partkey", "l_suppkey").limit(10)
    return first.select("subject_id", "hadm_id", _time("starttime"), "l_partkey")


# --- microbiology --------------------------------------------------------------

MICRO_TEXT = f"""CASE WHEN org_name IS NOT NULL THEN spec_type_desc || ': ' || test_name || ' → ' || org_name ||
             coalesce(' | ' || ab_name || '=' || {floats('dilution_value')} || '(' || interpretation || ')', '')
        WHEN comments IS NOT NULL THEN spec_type_desc || ': ' || test_name || ' → ' || comments
        ELSE spec_type_desc || ': ' || test_name END"""


def micro_text():
    return clinical.micro_result(
        *[F.col(c) for c in ["spec_type_desc", "test_name", "org_name", "ab_name", "dilution_value", "interpretation", "comments"]]
    )


@query("p3_micro_string", f"SELECT subject_id, micro_specimen_id, {MICRO_TEXT} AS text FROM microbiology")
def p3(v: Views) -> DataFrame:
    return v.microbiology.select("subject_id", "micro_specimen_id", micro_text().alias("text"))


MICRO_BUNDLES = f"""bundled AS (SELECT s.event_id, r.micro_specimen_id, r.charttime,
        string_agg({MICRO_TEXT}, '; ' ORDER BY {MICRO_TEXT}) AS micro_results, count(*) AS micro_count
        FROM microbiology r JOIN admission_windows s ON {RX_IN_STAY.format(t='charttime')}
        WHERE micro_specimen_id IS NOT NULL GROUP BY s.event_id, r.micro_specimen_id, r.charttime)"""


def micro_bundles(v: Views) -> DataFrame:
    known = v.microbiology.where(F.col("micro_specimen_id").isNotNull())
    placed = intervals.assign(known, v.admission_windows, "charttime", null_safe=True)
    return bundles.bundle(
        placed, ["event_id", "micro_specimen_id", "charttime"], micro_text(), [micro_text()], "micro_results", "micro_count"
    )


@query(
    "a3_time_bundle_micro",
    f"""WITH {MICRO_BUNDLES}
        SELECT event_id, micro_specimen_id, {ts('charttime')} AS charttime, micro_results, micro_count FROM bundled""",
)
def a3(v: Views) -> DataFrame:
    return micro_bundles(v).select(
        "event_id", "micro_specimen_id", _time("charttime"), _joined("micro_results"), "micro_count"
    )


@query(
    "a17_min_time",
    f"""WITH {MICRO_BUNDLES}
        SELECT event_id, {ts('min(charttime)')} AS first_charttime FROM bundled GROUP BY event_id""",
)
def a17(v: Views) -> DataFrame:
    """First specimen time of each stay."""
    return micro_bundles(v).groupBy("event_id").agg(format_ts(F.min("charttime")).alias("first_charttime"))


# --- chart events and ICU procedures -------------------------------------------

CHART_TEXT = f"""concat_ws(' ', coalesce(label, 'Unknown'), 'with value',
        coalesce(coalesce({floats('valuenum')}, flag) || coalesce(valueuom, unitname, ''), 'N/A'),
        CASE WHEN param_type = 'Numeric' THEN '(normal range: ' || {floats('lownormalvalue')} || '-' ||
             {floats('highnormalvalue')} || ')' END)"""


def chart_text():
    return clinical.chart_measurement(
        *[F.col(c) for c in ["label", "flag", "valuenum", "valueuom", "unitname", "param_type", "lownormalvalue", "highnormalvalue"]]
    )


CHART_COLUMNS = ["label", "unitname", "param_type", "lownormalvalue", "highnormalvalue"]


def chart_facts(v: Views) -> DataFrame:
    return lookups.with_items(v.labevents, v.d_items, CHART_COLUMNS)


@query("p4_chart_string", f"SELECT labevent_id, {CHART_TEXT} AS text FROM labevents LEFT JOIN d_items USING (itemid)")
def p4(v: Views) -> DataFrame:
    return chart_facts(v).select("labevent_id", chart_text().alias("text"))


def icu_windows(v: Views) -> DataFrame:
    return v.stay_windows.where(F.col("label") == "ICUStay")


@query(
    "jn5_icu_chart_interval",
    f"""SELECT l.labevent_id, s.event_id, {ts('l.charttime')} AS charttime
        FROM labevents l JOIN stay_windows s ON {IN_STAY} WHERE s.label = 'ICUStay'""",
)
def jn5(v: Views) -> DataFrame:
    return intervals.assign(v.labevents, icu_windows(v), "charttime").select("labevent_id", "event_id", _time("charttime"))


@query(
    "a4_time_bundle_chart",
    f"""WITH placed AS (SELECT l.*, s.event_id FROM labevents l JOIN stay_windows s ON {IN_STAY} WHERE s.label = 'ICUStay'),
        texts AS (SELECT p.event_id, p.charttime, p.itemid, p.labevent_id, {CHART_TEXT} AS text
                  FROM placed p LEFT JOIN d_items USING (itemid))
        SELECT event_id, {ts('charttime')} AS charttime, string_agg(text, '; ' ORDER BY itemid, labevent_id) AS chart_measurements,
               count(*) AS measurement_count FROM texts GROUP BY event_id, charttime""",
)
def a4(v: Views) -> DataFrame:
    placed = intervals.assign(v.labevents, icu_windows(v), "charttime").drop("label")
    described = lookups.with_items(placed, v.d_items, CHART_COLUMNS)
    made = bundles.bundle(
        described, ["event_id", "charttime"], chart_text(), [F.col("itemid"), F.col("labevent_id")],
        "chart_measurements", "measurement_count",
    )
    return made.select("event_id", _time("charttime"), _joined("chart_measurements"), "measurement_count")


PROC_TEXT = f"""concat_ws(' ', ordercategoryname, '(' || ordercategorydescription || ')', '-', coalesce(label, 'Unknown'),
        'with value ' || {floats('nullif(value, 0)')} || coalesce(valueuom, ''),
        CASE WHEN lownormalvalue IS NOT NULL OR highnormalvalue IS NOT NULL THEN '(Ref: ' || coalesce({floats('lownormalvalue')}, '0')
             || ' - ' || coalesce({floats('highnormalvalue')}, '∞') || ')' END)"""
PROC_ITEMS = ["label", "lownormalvalue", "highnormalvalue"]
# One bound is hidden on some items, so that open ranges occur.
OPEN_ITEMS = """open_items AS (SELECT itemid, label, CASE WHEN category <> 'SMALL' THEN lownormalvalue END AS lownormalvalue,
        CASE WHEN category <> 'LARGE' THEN highnormalvalue END AS highnormalvalue FROM d_items)"""


def open_items(v: Views) -> DataFrame:
    kind = F.col("category")
    return v.d_items.select(
        "itemid", "label",
        F.when(kind != "SMALL", F.col("lownormalvalue")).alias("lownormalvalue"),
        F.when(kind != "LARGE", F.col("highnormalvalue")).alias("highnormalvalue"),
    )


def proc_text():
    return clinical.icu_procedure(
        *[F.col(c) for c in ["ordercategoryname", "ordercategorydescription", "label", "value", "valueuom", "lownormalvalue", "highnormalvalue"]]
    )


@query(
    "p5_proc_string",
    f"""WITH {OPEN_ITEMS} SELECT stay_id, itemid, {PROC_TEXT} AS text FROM procedureevents LEFT JOIN open_items USING (itemid)""",
)
def p5(v: Views) -> DataFrame:
    return lookups.with_items(v.procedureevents, open_items(v), PROC_ITEMS).select("stay_id", "itemid", proc_text().alias("text"))


@query(
    "f7_task_only",
    f"""SELECT stay_id, itemid, {ts('starttime')} AS starttime, value FROM procedureevents
        WHERE ordercategorydescription = 'Task'""",
)
def f7(v: Views) -> DataFrame:
    return lookups.tasks(v.procedureevents).select("stay_id", "itemid", _time("starttime"), "value")


@query(
    "jn7_stay_id_join",
    f"""SELECT CAST(s.stay_id AS VARCHAR) AS event_id, s.subject_id, p.itemid, {ts('p.starttime')} AS starttime
        FROM procedureevents p JOIN icustays s ON p.stay_id = s.stay_id WHERE ordercategorydescription = 'Task'""",
)
def jn7(v: Views) -> DataFrame:
    return lookups.on_icu_stay(lookups.tasks(v.procedureevents), v.icustays).select(
        "event_id", "subject_id", "itemid", _time("starttime")
    )


@query(
    "jn6_icd_date_interval",
    """SELECT p.subject_id, p.hadm_id, p.icd_code, strftime(p.chartdate, '%Y-%m-%d') AS chartdate, s.event_id
       FROM icd_procedures p JOIN admission_windows s ON p.subject_id = s.subject_id AND p.hadm_id = s.hadm_id
        AND (s.intime IS NULL OR s.outtime IS NULL
             OR p.chartdate BETWEEN CAST(s.intime AS DATE) AND CAST(s.outtime AS DATE))""",
)
def jn6(v: Views) -> DataFrame:
    placed = intervals.assign_dates(v.icd_procedures, v.admission_windows, "chartdate")
    return placed.select("subject_id", "hadm_id", "icd_code", F.date_format("chartdate", "yyyy-MM-dd").alias("chartdate"), "event_id")


@query(
    "jn6_icd_date_strict",
    """SELECT p.subject_id, p.hadm_id, p.icd_code, strftime(p.chartdate, '%Y-%m-%d') AS chartdate, s.event_id
       FROM icd_procedures p JOIN admission_windows s ON p.subject_id = s.subject_id AND p.hadm_id = s.hadm_id
        AND (s.intime IS NULL OR s.outtime IS NULL
             OR CAST(p.chartdate AS TIMESTAMP) BETWEEN s.intime + INTERVAL 1 HOUR AND s.outtime)""",
)
def jn6_strict(v: Views) -> DataFrame:
    """Dates as midnight: stays that begin at one o'clock lose their first day."""
    later = v.admission_windows.withColumn("intime", F.expr("timestampadd(HOUR, 1, intime)"))
    placed = intervals.assign_dates(v.icd_procedures, later, "chartdate", strict=True)
    return placed.select("subject_id", "hadm_id", "icd_code", F.date_format("chartdate", "yyyy-MM-dd").alias("chartdate"), "event_id")


@query(
    "jn8_orphan_anti_join",
    """WITH attached AS (SELECT DISTINCT p.hadm_id, p.chartdate FROM icd_procedures p JOIN admission_windows s
            ON p.subject_id = s.subject_id AND p.hadm_id = s.hadm_id AND (s.intime IS NULL OR s.outtime IS NULL
             OR p.chartdate BETWEEN CAST(s.intime AS DATE) AND CAST(s.outtime AS DATE)))
       SELECT p.subject_id, p.hadm_id, p.icd_code, strftime(p.chartdate, '%Y-%m-%d') AS chartdate FROM icd_procedures p
       WHERE NOT EXISTS (SELECT 1 FROM attached a WHERE a.hadm_id = p.hadm_id AND a.chartdate = p.chartdate)""",
)
def jn8(v: Views) -> DataFrame:
    attached = intervals.assign_dates(v.icd_procedures, v.admission_windows, "chartdate")
    left = intervals.not_attached(v.icd_procedures, attached, "chartdate")
    return left.select("subject_id", "hadm_id", "icd_code", F.date_format("chartdate", "yyyy-MM-dd").alias("chartdate"))


@query(
    "a5_time_bundle_proc",
    f"""WITH {OPEN_ITEMS}, icu AS (
            SELECT CAST(s.stay_id AS VARCHAR) AS event_id, p.starttime AS time, 'ICU_EVENTS' AS source, {PROC_TEXT} AS text
            FROM procedureevents p JOIN icustays s ON p.stay_id = s.stay_id LEFT JOIN open_items USING (itemid)
            WHERE ordercategorydescription = 'Task'),
        icd AS (SELECT s.event_id, CAST(p.chartdate AS TIMESTAMP) AS time, 'ICD' AS source, coalesce(long_title, 'Unknown') AS text
            FROM icd_procedures p JOIN admission_windows s ON p.subject_id = s.subject_id AND p.hadm_id = s.hadm_id
              AND (s.intime IS NULL OR s.outtime IS NULL OR p.chartdate BETWEEN CAST(s.intime AS DATE) AND CAST(s.outtime AS DATE))
            LEFT JOIN d_icd d ON p.icd_code = d.icd_code AND p.icd_version = d.icd_version)
        SELECT event_id, {ts('time')} AS time, source, string_agg(text, '; ' ORDER BY text) AS procedures, count(*) AS procedure_count
        FROM (SELECT * FROM icu UNION ALL SELECT * FROM icd) GROUP BY event_id, time, source""",
)
def a5(v: Views) -> DataFrame:
    icu = lookups.with_items(
        lookups.on_icu_stay(lookups.tasks(v.procedureevents), v.icustays), open_items(v), PROC_ITEMS
    ).select("event_id", F.col("starttime").alias("time"), F.lit("ICU_EVENTS").alias("source"), proc_text().alias("text"))
    icd = lookups.with_titles(
        intervals.assign_dates(v.icd_procedures, v.admission_windows, "chartdate"), v.d_icd
    ).select(
        "event_id",
        F.col("chartdate").cast("timestamp_ntz").alias("time"),
        F.lit("ICD").alias("source"),
        clinical.or_default(F.col("long_title"), "Unknown").alias("text"),
    )
    made = bundles.bundle(
        icu.unionByName(icd), ["event_id", "time", "source"], F.col("text"), [], "procedures", "procedure_count"
    )
    return made.select("event_id", _time("time"), "source", _joined("procedures"), "procedure_count")


# --- emergency lists and diagnoses ----------------------------------------------

ED_ORDER = "charttime, l_linenumber, l_partkey, l_suppkey"


@query(
    "jn11_stay_child_join",
    """SELECT stay_id, subject_id, name, etcdescription FROM ed_lines JOIN edstays USING (stay_id)""",
)
def jn11(v: Views) -> DataFrame:
    return lookups.on_ed_stay(v.ed_lines, v.edstays).select("stay_id", "subject_id", "name", "etcdescription")


@query(
    "a6_group_list_meds",
    f"""SELECT stay_id, string_agg(name || ' - ' || coalesce(etcdescription, 'No Classification'), '; ' ORDER BY {ED_ORDER}) AS medications,
               count(*) AS medication_count, {ts(f"arg_min(charttime, (l_linenumber, l_partkey, l_suppkey))")} AS charttime
        FROM (SELECT l.* FROM ed_lines l JOIN edstays USING (stay_id)) GROUP BY stay_id""".replace(ED_ORDER, "l_linenumber, l_partkey, l_suppkey"),
)
def a6(v: Views) -> DataFrame:
    rows = lookups.on_ed_stay(v.ed_lines, v.edstays)
    text = clinical.previous_medicine(F.col("name"), F.col("etcdescription"))
    order = [F.col(c) for c in ["l_linenumber", "l_partkey", "l_suppkey"]]
    made = bundles.list_by_stay(rows, text, order, "charttime")
    return made.select("stay_id", _joined("medications"), "medication_count", _time("charttime"))


@query(
    "a6_administered_meds",
    f"""SELECT stay_id, coalesce(string_agg(given, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS medications,
               count(given) AS medication_count, {ts("arg_min(charttime, (l_linenumber, l_partkey, l_suppkey))")} AS charttime
        FROM (SELECT l.* FROM ed_lines l JOIN edstays USING (stay_id)) GROUP BY stay_id""",
)
def a6_given(v: Views) -> DataFrame:
    rows = lookups.on_ed_stay(v.ed_lines, v.edstays)
    order = [F.col(c) for c in ["l_linenumber", "l_partkey", "l_suppkey"]]
    made = bundles.list_by_stay(rows, F.col("given"), order, "charttime")
    return made.select("stay_id", _joined("medications"), "medication_count", _time("charttime"))


@query(
    "a7_group_list_ed_dx",
    """SELECT stay_id, any_value(subject_id) AS subject_id, count(*) AS diagnosis_count,
              string_agg(icd_title, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS complete_diagnosis
       FROM (SELECT l.*, e.subject_id FROM ed_lines l JOIN edstays e USING (stay_id)) GROUP BY stay_id""",
)
def a7(v: Views) -> DataFrame:
    rows = lookups.on_ed_stay(v.ed_lines, v.edstays)
    made = diagnoses.emergency_list(rows, ["l_linenumber", "l_partkey", "l_suppkey"])
    return made.select("stay_id", "subject_id", "diagnosis_count", _joined("complete_diagnosis"))


@query(
    "a8_ordered_dx_list",
    """SELECT subject_id, hadm_id, count(*) AS diagnosis_count,
              string_agg(coalesce(long_title, 'Unknown'), '; ' ORDER BY seq_num, coalesce(long_title, 'Unknown')) AS complete_diagnosis
       FROM diagnoses GROUP BY subject_id, hadm_id""",
)
def a8(v: Views) -> DataFrame:
    return diagnoses.admission_list(v.diagnoses).select(
        "subject_id", "hadm_id", "diagnosis_count", _joined("complete_diagnosis")
    )


@query(
    "a9_patient_dx_union",
    """WITH named AS (SELECT subject_id, long_title AS title, hadm_id, seq_num FROM diagnoses WHERE trim(long_title) <> ''),
       firsts AS (SELECT * FROM named
            QUALIFY row_number() OVER (PARTITION BY subject_id, lower(title) ORDER BY hadm_id, seq_num, title) = 1)
       SELECT subject_id, string_agg(title, '; ' ORDER BY hadm_id, seq_num, title) AS all_diagnoses
       FROM firsts GROUP BY subject_id""",
)
def a9(v: Views) -> DataFrame:
    items = v.diagnoses.withColumnRenamed("long_title", "title")
    return diagnoses.patient_union(items, ["hadm_id", "seq_num"]).select("subject_id", _joined("all_diagnoses"))
