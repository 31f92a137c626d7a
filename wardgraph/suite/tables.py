"""Sources and sinks, cohort, filters, set operations, upserts and the status log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.functions.times import format_ts
from wardgraph.operators import flow, lookups, tracker, upsert
from wardgraph.plans import cohort
from wardgraph.session import shared_dir
from wardgraph.sources import files, schemas
from wardgraph.suite.registry import query
from wardgraph.suite.sql_views import VIEWS, ts
from wardgraph.suite.views import Views


def _text(c: str):
    return format_ts(F.col(c)).alias(c)


def _path(v: Views, name: str) -> str:
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks --------------------------------------------------------------


def hospital_csv(v: Views, *wanted: str) -> str:
    """The views as a folder of CSV files, laid out as the hospital delivers them: those wanted, or all."""
    tables = {
        "hosp/patients": lambda: v.patients,
        "hosp/admissions": lambda: v.admissions,
        "hosp/prescriptions": lambda: v.prescriptions,
        "hosp/d_icd_procedures": lambda: v.d_icd,
        "ed/edstays": lambda: v.edstays,
        "hosp/omr": lambda: v.patients.select("subject_id", F.lit("x").alias("result_name")),
    }

    def root() -> DataFrame:
        return v.spark.createDataFrame([(_path(v, "csv"),)], "path string")

    def deliver(place: str) -> DataFrame:
        table, path = tables[place](), f"{folder}/{place}.csv"
        times = [f.name for f in table.schema.fields if f.dataType.simpleString().startswith("timestamp")]
        files.csv_sink(table.withColumns({c: format_ts(F.col(c)) for c in times}), path, "overwrite")
        return v.spark.createDataFrame([(path,)], "path string")

    folder = v.once("hospital_csv", root).head()["path"]
    for place in wanted or tables:
        v.once(f"csv_{place.replace('/', '_')}", lambda place=place: deliver(place))
    return folder


@query(
    "s1_csv_scan",
    f"SELECT hadm_id, subject_id, {ts('admittime')} AS admittime, admission_type FROM admissions",
)
def s1(v: Views) -> DataFrame:
    path = f"{hospital_csv(v, 'hosp/admissions')}/hosp/admissions.csv"
    scanned = files.csv_scan(v.spark, path, schemas.HOSP["admissions"], ["hadm_id", "subject_id", "admittime", "admission_type"])
    return scanned.withColumn("admittime", format_ts(F.col("admittime")))


COHORT = "cohort AS (SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P')"
COHORT_ADMISSIONS = "mine AS (SELECT DISTINCT hadm_id FROM admissions SEMI JOIN cohort USING (subject_id))"


def cohort_list(v: Views) -> DataFrame:
    """Patient numbers as text with blanks and repeats, as a list file has them."""
    urgent = v.table("orders").where(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("subject_id")
    )


def cohort_ids(v: Views) -> DataFrame:
    return cohort.ids(cohort_list(v))


def cohort_admissions(v: Views) -> DataFrame:
    return cohort.admissions_of(cohort_ids(v), v.admissions)


@query(
    "s2_chunked_scan",
    f"""WITH {COHORT}, {COHORT_ADMISSIONS} SELECT hadm_id, subject_id, drug, {ts('starttime')} AS starttime
        FROM prescriptions SEMI JOIN mine USING (hadm_id)""",
)
def s2(v: Views) -> DataFrame:
    """The scan is split by Spark; the filter runs on each split."""
    path = f"{hospital_csv(v, 'hosp/prescriptions')}/hosp/prescriptions.csv"
    scanned = files.csv_scan(v.spark, path, schemas.HOSP["prescriptions"])
    kept = cohort.restrict(scanned, cohort_ids(v), cohort_admissions(v))
    return kept.select("hadm_id", "subject_id", "drug", _text("starttime"))


@query("s3_optional_source", "SELECT subject_id, stay_id FROM edstays")
def s3(v: Views) -> DataFrame:
    """A missing table reads as an empty one and leaves the others alone."""
    root = hospital_csv(v, "ed/edstays")

    def read(name: str) -> DataFrame:
        path = f"{root}/ed/{name}.csv"
        return files.optional(v.spark, lambda: files.csv_scan(v.spark, path, schemas.ED[name]), schemas.ED[name])

    stays = read("edstays").select("subject_id", "stay_id")
    return stays.unionByName(read("triage").select("subject_id", "stay_id"))


@query(
    "s4_multi_table_ingest",
    f"""WITH {COHORT}, {COHORT_ADMISSIONS}
        SELECT 'hosp/patients' AS name, count(*) AS kept FROM patients SEMI JOIN cohort USING (subject_id)
        UNION ALL SELECT 'hosp/admissions', count(*) FROM admissions SEMI JOIN mine USING (hadm_id)
        UNION ALL SELECT 'hosp/prescriptions', count(*) FROM prescriptions SEMI JOIN mine USING (hadm_id)
        UNION ALL SELECT 'hosp/d_icd_procedures', count(*) FROM d_icd
        UNION ALL SELECT 'hosp/omr', count(*) FROM patients SEMI JOIN cohort USING (subject_id)
        UNION ALL SELECT 'ed/edstays', count(*) FROM edstays SEMI JOIN mine USING (hadm_id)""",
)
def s4(v: Views) -> DataFrame:
    def ingest():
        target = _path(v, "cut")
        done = cohort.cut(v.spark, hospital_csv(v), target, cohort_list(v))
        out = None
        for name in done:
            one = v.spark.read.parquet(f"{target}/{name}").agg(F.count(F.lit(1)).alias("kept"))
            one = one.select(F.lit(name).alias("name"), "kept")
            out = one if out is None else out.unionByName(one)
        return out

    return v.once("ingest", ingest)


@query(
    "s4_note_csv",
    "SELECT doc_id, length(text) AS chars, md5(text) AS digest, lang FROM documents",
)
def s4_notes(v: Views) -> DataFrame:
    """Texts with line breaks and quotes as CSV files, one a task that writes them, read in splits."""

    def deliver():
        target = _path(v, "texts.csv")
        files.csv_sink(v.table("documents").select("lang", "text", "doc_id"), target)
        return files.notes_csv_scan(v.spark, target, "doc_id bigint, text string, lang string")

    read = v.once("texts_csv", deliver)
    return read.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"), "lang")


@query(
    "s5_csv_sink_append",
    "SELECT o_orderstatus AS status, count(*) * 2 AS n FROM orders GROUP BY o_orderstatus",
)
def s5(v: Views) -> DataFrame:
    """Two batches appended; the header is not read as a row."""

    def appended():
        path = _path(v, "appended")
        rows = v.admissions.select("hadm_id", F.col("discharge_location").alias("status"))
        files.csv_sink(rows, path)
        files.csv_sink(rows, path)
        return files.csv_scan(v.spark, path, "hadm_id bigint, status string")

    return v.once("appended", appended).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s6_empty_sink",
    "SELECT hadm_id, discharge_location FROM admissions WHERE discharge_location = 'nowhere'",
)
def s6(v: Views) -> DataFrame:
    """Nothing matches, and the written table still has its columns."""

    def emptied():
        path = _path(v, "empty")
        rows = v.admissions.select("hadm_id", "discharge_location").where(F.col("discharge_location") == "nowhere")
        files.append(rows, path)
        return v.spark.read.parquet(path)

    return v.once("emptied", emptied)


@query("s7_dictionary_copy", "SELECT icd_code, icd_version, long_title FROM d_icd")
def s7(v: Views) -> DataFrame:
    return cohort.restrict(v.d_icd, cohort_ids(v), cohort_admissions(v))


# --- cohort and filters ---------------------------------------------------------------


@query("f1_cohort_ids", f"WITH {COHORT} SELECT subject_id FROM cohort")
def f1(v: Views) -> DataFrame:
    return cohort_ids(v)


@query("f2_derive_hadm_ids", f"WITH {COHORT}, {COHORT_ADMISSIONS} SELECT hadm_id FROM mine")
def f2(v: Views) -> DataFrame:
    return cohort_admissions(v)


@query(
    "f3_cohort_filter",
    f"WITH {COHORT}, {COHORT_ADMISSIONS} SELECT l_orderkey, l_partkey, l_suppkey, hadm_id, subject_id FROM prescriptions SEMI JOIN mine USING (hadm_id)",
)
def f3(v: Views) -> DataFrame:
    kept = cohort.restrict(v.prescriptions, cohort_ids(v), cohort_admissions(v))
    return kept.select("l_orderkey", "l_partkey", "l_suppkey", "hadm_id", "subject_id")


@query(
    "f3_cohort_filter_keep_null",
    f"""WITH {COHORT}, {COHORT_ADMISSIONS} SELECT l_orderkey, l_partkey, l_suppkey, subject_id FROM prescriptions SEMI JOIN mine USING (hadm_id)
        UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, subject_id FROM prescriptions SEMI JOIN cohort USING (subject_id) WHERE hadm_id IS NULL""",
)
def f3_null(v: Views) -> DataFrame:
    kept = cohort.restrict(v.prescriptions, cohort_ids(v), cohort_admissions(v), keep_null_hadm=True)
    return kept.select("l_orderkey", "l_partkey", "l_suppkey", "subject_id")


@query(
    "f3_cohort_filter_by_subject",
    f"WITH {COHORT} SELECT subject_id, gender, anchor_age FROM patients SEMI JOIN cohort USING (subject_id)",
)
def f3_subject(v: Views) -> DataFrame:
    return cohort.restrict(v.patients, cohort_ids(v), cohort_admissions(v)).select("subject_id", "gender", "anchor_age")


@query(
    "f4_active_patients",
    """SELECT subject_id, gender FROM patients WHERE subject_id IN (SELECT subject_id FROM flow_admissions)
       OR subject_id IN (SELECT subject_id FROM edstays)""",
)
def f4(v: Views) -> DataFrame:
    return cohort.active_patients(v.patients, v.flow_admissions, v.edstays).select("subject_id", "gender")


@query(
    "f5_required_ids",
    "SELECT labevent_id, subject_id, hadm_id FROM labevents WHERE hadm_id IS NOT NULL AND subject_id IS NOT NULL AND labevent_id IS NOT NULL",
)
def f5(v: Views) -> DataFrame:
    return lookups.identified(v.labevents, ["labevent_id", "subject_id", "hadm_id"]).select("labevent_id", "subject_id", "hadm_id")


@query(
    "f8_nonblank_trim",
    "SELECT hadm_id, trim(admit_provider_id) AS provider_id FROM admissions WHERE trim(admit_provider_id) <> ''",
)
def f8(v: Views) -> DataFrame:
    return lookups.nonblank(v.admissions, "admit_provider_id", "provider_id").select("hadm_id", "provider_id")


@query(
    "jn10_admission_link",
    """SELECT p.hadm_id, p.subject_id, p.l_partkey, p.l_suppkey FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN o_custkey + 1 ELSE o_custkey END AS subject_id,
              l_orderkey AS hadm_id FROM lines) p JOIN admissions a ON p.hadm_id = a.hadm_id AND p.subject_id = a.subject_id""",
)
def jn10(v: Views) -> DataFrame:
    """Facts of a wrong patient never link to the admission."""
    claimed = F.when(F.col("l_returnflag") == "R", F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    facts = v.lines.select(F.col("l_orderkey").alias("hadm_id"), claimed.alias("subject_id"), "l_partkey", "l_suppkey")
    return lookups.on_admission(facts, v.admissions)


# --- set operations and order -----------------------------------------------------------


@query("x1_union_ids", "SELECT subject_id FROM flow_admissions UNION SELECT subject_id FROM edstays")
def x1(v: Views) -> DataFrame:
    return v.flow_admissions.select("subject_id").union(v.edstays.select("subject_id")).distinct()


@query(
    "x2_union_events",
    f"""WITH outside AS (SELECT * FROM transfers t WHERE eventtype = 'ed' AND NOT EXISTS (
            SELECT 1 FROM edstays e WHERE e.subject_id = t.subject_id AND e.stay_id = t.transfer_id))
        SELECT CAST(stay_id AS VARCHAR) AS event_id, 'ed' AS eventtype, {ts('intime')} AS intime FROM edstays WHERE hadm_id IS NOT NULL
        UNION ALL SELECT CAST(transfer_id AS VARCHAR), 'ed', {ts('intime')} FROM outside WHERE hadm_id IS NOT NULL
        UNION ALL SELECT CAST(transfer_id AS VARCHAR), eventtype, {ts('intime')} FROM transfers
                  WHERE eventtype IN ('admit', 'transfer') AND hadm_id IS NOT NULL""",
)
def x2(v: Views) -> DataFrame:
    return flow.opening_events(v.edstays, v.transfers).select("event_id", "eventtype", _text("intime"))


@query(
    "x4_membership_minus",
    "SELECT subject_id FROM patients WHERE subject_id NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
)
def x4(v: Views) -> DataFrame:
    return upsert.only_new(v.patients, v.transfers.unionByName(v.labevents, allowMissingColumns=True), ["subject_id"]).select("subject_id")


@query(
    "x5_list_concat_distinct",
    """WITH drugs AS (SELECT subject_id, l_orderkey % 2 AS odd, drug FROM prescriptions WHERE drug IS NOT NULL),
       a AS (SELECT subject_id, list_sort(list(DISTINCT drug)) AS l FROM drugs WHERE odd = 0 GROUP BY 1),
       b AS (SELECT subject_id, list_sort(list(DISTINCT drug)) AS l FROM drugs WHERE odd = 1 GROUP BY 1)
       SELECT coalesce(a.subject_id, b.subject_id) AS subject_id,
              array_to_string(list_concat(coalesce(a.l, []), coalesce(b.l, [])), '; ') AS drugs
       FROM a FULL JOIN b ON a.subject_id = b.subject_id""",
)
def x5(v: Views) -> DataFrame:
    """Distinct lists of two branches put one after the other.

    Both branches come from one grouping: each row names its branch.
    """
    known = v.prescriptions.where(F.col("drug").isNotNull()).select("subject_id", (F.col("l_orderkey") % 2).alias("branch"), "drug").distinct()
    rows = F.array_sort(F.collect_list(F.struct("branch", "drug")))
    return known.groupBy("subject_id").agg(F.array_join(F.transform(rows, lambda r: r["drug"]), "; ").alias("drugs"))


@query(
    "o1_multi_key_sort",
    f"""SELECT subject_id, CAST(hadm_id AS VARCHAR) AS hadm_id, {ts('intime')} AS intime, transfer_id FROM transfers
        ORDER BY subject_id, transfers.hadm_id NULLS LAST, transfers.intime NULLS LAST, transfer_id""",
)
def o1(v: Views) -> DataFrame:
    ordered = v.transfers.orderBy(
        "subject_id", F.col("hadm_id").asc_nulls_last(), F.col("intime").asc_nulls_last(), "transfer_id"
    )
    return ordered.select("subject_id", F.col("hadm_id").cast("string").alias("hadm_id"), _text("intime"), "transfer_id")


# --- upserts ----------------------------------------------------------------------------

VIEWS["old_admissions"] = """
    SELECT hadm_id, subject_id, 'before' AS name, admission_type, admittime FROM admissions WHERE discharge_location <> 'O'"""


def old_admissions(v: Views) -> DataFrame:
    """What an earlier run stored: the admissions that are not open."""
    return v.admissions.where(F.col("discharge_location") != "O").select(
        "hadm_id", "subject_id", F.lit("before").alias("name"), "admission_type", "admittime"
    )


def new_admissions(v: Views) -> DataFrame:
    """What this run delivers: the admissions that are not final, with other values."""
    return v.admissions.where(F.col("discharge_location") != "F").select(
        "hadm_id", "subject_id", F.lit("after").alias("name"), F.upper(F.concat(F.lit("new "), "admission_type")).alias("admission_type"), "admittime"
    )


@query(
    "u1_upsert_by_key",
    f"""WITH incoming AS (SELECT hadm_id, subject_id, 'after' AS name, upper('new ' || admission_type) AS admission_type, admittime
            FROM admissions WHERE discharge_location <> 'F')
        SELECT coalesce(t.hadm_id, s.hadm_id) AS hadm_id, coalesce(t.subject_id, s.subject_id) AS subject_id,
               coalesce(s.name, t.name) AS name, CASE WHEN t.hadm_id IS NOT NULL THEN t.admission_type ELSE s.admission_type END AS admission_type,
               {ts('coalesce(t.admittime, s.admittime)')} AS admittime
        FROM old_admissions t FULL JOIN incoming s ON t.hadm_id = s.hadm_id""",
)
def u1(v: Views) -> DataFrame:
    """Known admissions take only the name; new ones take everything."""
    merged = upsert.upsert(old_admissions(v), new_admissions(v), ["hadm_id"], on_match=["name"])
    return merged.withColumn("admittime", format_ts(F.col("admittime")))


@query(
    "u2_set_property",
    """SELECT subject_id, gender, CASE WHEN n > 0 THEN n ELSE 0 END AS total FROM (
           SELECT p.subject_id, gender, (SELECT count(*) FROM admissions a WHERE a.subject_id = p.subject_id) AS n FROM patients p)""",
)
def u2(v: Views) -> DataFrame:
    target = v.patients.select("subject_id", "gender", F.lit(0).cast("bigint").alias("total"))
    counts = flow.admission_counts(v.admissions).withColumnRenamed("total_number_of_admissions", "total")
    return upsert.set_columns(target, counts, ["subject_id"], ["total"])


@query(
    "jn13_incremental_anti",
    "SELECT hadm_id, subject_id FROM admissions WHERE discharge_location <> 'F' AND hadm_id NOT IN (SELECT hadm_id FROM old_admissions)",
)
def jn13(v: Views) -> DataFrame:
    return upsert.only_new(new_admissions(v), old_admissions(v), ["hadm_id"]).select("hadm_id", "subject_id")


# --- the status log -----------------------------------------------------------------------

LATEST = """latest AS (SELECT subject_id, script_name, arg_max(status, (processed_at, seq)) AS status FROM tracker GROUP BY 1, 2)"""


@query("a14_latest_status", f"WITH {LATEST} SELECT subject_id, script_name, status FROM latest")
def a14(v: Views) -> DataFrame:
    return tracker.latest_status(v.tracker)


@query(
    "a15_status_summary",
    f"WITH {LATEST} SELECT script_name, count(*) AS patients FROM latest WHERE status = 'success' GROUP BY 1",
)
def a15(v: Views) -> DataFrame:
    return tracker.summary(v.tracker)


@query(
    "u7_tracker_append",
    """SELECT script_name, status, count(*) AS entries FROM (SELECT script_name, status FROM tracker
           UNION ALL SELECT 'new step', 'success' FROM patients) GROUP BY 1, 2""",
)
def u7(v: Views) -> DataFrame:
    """History of the log after a step has been noted for every patient."""

    def appended():
        path = _path(v, "log")
        files.append(v.tracker.drop("seq"), path)
        files.append(tracker.entries(v.patients, "new step"), path)
        return v.spark.read.parquet(path)

    return v.once("log", appended).groupBy("script_name", "status").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "u8_tracker_sync",
    f"""WITH {LATEST} SELECT DISTINCT subject_id, 'signup' AS script_name, 'success' AS status FROM transfers
        WHERE subject_id NOT IN (SELECT subject_id FROM latest WHERE script_name = 'signup' AND status = 'success')""",
)
def u8(v: Views) -> DataFrame:
    lost = tracker.missing_success(v.transfers, v.tracker, "signup")
    return tracker.entries(lost, "signup").drop("processed_at")


@query(
    "u10_needs_embedding",
    f"""WITH {LATEST} SELECT subject_id FROM patients WHERE subject_id NOT IN (SELECT subject_id FROM vectors WHERE label > 3)
        AND subject_id IN (SELECT subject_id FROM latest WHERE script_name IN ('signup', 'view') AND status = 'success'
                           GROUP BY 1 HAVING count(*) = 2)""",
)
def u10(v: Views) -> DataFrame:
    stored = v.vectors.where(F.col("label") > 3)
    return tracker.needs_embedding(v.patients, stored, v.tracker, ["signup", "view"])
