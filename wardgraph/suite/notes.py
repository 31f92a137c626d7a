"""Discharge notes made of the order table, and what must be read out of them.

Each order gives one note. The notes are put together from expressions that
mean the same in Spark and in SQL; the checks say what each part must be from
the columns, without reading the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.functions import notes as N
from wardgraph.functions.text import clean
from wardgraph.plans import notes as job
from wardgraph.session import shared_dir
from wardgraph.suite.registry import query
from wardgraph.suite.sql_views import VIEWS
from wardgraph.suite.views import Views

K = "o_orderkey"


def _n(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


SEX = "CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END"
SERVICE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'SURGERY' WHEN '2-HIGH' THEN 'ORTHOPAEDICS' ELSE 'MEDICINE' END"
ALLERGY = "CASE o_orderstatus WHEN 'F' THEN 'Penicillins / Sulfa' WHEN 'O' THEN 'No Known Allergies / Adverse Drug Reactions' ELSE '___' END"
COMPLAINT = f"('pain for ' || {_n(K + ' % 9 + 1')} || ' days')"
HR, SBP, DBP = _n(f"60 + {K} % 40"), _n(f"100 + {K} % 50"), _n(f"60 + {K} % 30")
RR, OX = _n(f"12 + {K} % 8"), _n(f"90 + {K} % 9")
TEMP = f"({_n('97 + ' + K + ' % 3')} || '.' || {_n(K + ' % 9 + 1')})"
NA, POT = _n(f"130 + {K} % 15"), f"({_n('3 + ' + K + ' % 3')} || '.' || {_n(K + ' % 9')})"
WBC, HGB = f"({_n('4 + ' + K + ' % 9')} || '.' || {_n(K + ' % 7')})", f"({_n('9 + ' + K + ' % 6')} || '.' || {_n(K + ' % 5')})"
CREAT = f"('0.' || {_n('1 + ' + K + ' % 9')})"
DOSE = _n(f"10 * (1 + {K} % 4)")
NL = "chr(10)"

# Parts of a note. {NL} is a line break; anything in ⟦⟧ is one of the expressions above.
TEMPLATE = [
    "'Name:  ___                     Unit No:   ___'", NL, "' '", NL,
    "'Admission Date:  ___              Discharge Date:   ___'", NL, "' '", NL,
    "'Date of Birth:  ___             Sex:   '", SEX, NL, "' '", NL,
    "'Service: '", SERVICE, NL, "' '", NL,
    "'Allergies: '", NL, ALLERGY, NL, "' '", NL,
    "'Attending: '", "CASE WHEN o_orderstatus = 'P' THEN '___.' ELSE 'Dr. Lee' END", NL, "' '", NL,
    "CASE o_orderstatus WHEN 'F' THEN 'Chief Complaint:' WHEN 'O' THEN 'CHIEF COMPLAINT:' ELSE 'Chief Complaint' END", NL, COMPLAINT, "' '", NL, "' '", NL,
    "'Major Surgical or Invasive Procedure:'", NL,
    "CASE o_orderstatus WHEN 'F' THEN 'None' WHEN 'O' THEN '___ Paracentesis' ELSE 'Paracentesis' || chr(10) || 'Upper endoscopy' END", NL, "' '", NL,
    "'History of Present Illness:'", NL, "'___ presents with '", COMPLAINT, "' and fever.'", NL,
    "'In the ED, initial vitals were '", TEMP, "' '", HR, "' '", SBP, "'/'", DBP, "' '", RR, "' '", OX, "'%RA'", NL,
    "'Labs were significant for Na '", NA, "' K '", POT, "'. CXR showed a clear field '", _n(f"{K} % 5"), "'.'", NL,
    "'She was given Morphine Sulfate 5 mg IV once, and a GI cocktail.'", NL, "' '", NL,
    "'Past Medical History:'", NL,
    "CASE o_orderstatus WHEN 'F' THEN '- HCV Cirrhosis: genotype' || chr(10) || '  three' || chr(10) || '- COPD' "
    "WHEN 'O' THEN '1. Asthma' || chr(10) || '2. Gout' ELSE 'Diabetes' || chr(10) || chr(10) || 'PTSD' END", NL, "' '", NL,
    "'Social History:'", NL, "'Lives alone. Works nights.'", NL,
    "'Family History:'", NL, "'Mother with gout. She quit smoking '", _n(f"{K} % 7 + 2"), "' years ago.'", NL, "' '", NL,
    "'Physical Exam:'", NL,
    "'VS: '", TEMP, "' PO '", SBP, "' / '", DBP, "' '", HR, "' '", RR, "' '", OX, "' ra'", NL,
    "'GENERAL: alert '", _n(f"{K} % 4"), NL, "'HEENT: clear'", NL, "'NECK: supple'", NL, "' no nodes'", NL, "'CARDIAC: RRR '", HR, NL,
    "'LUNG: clear'", NL, "'ABDOMEN: soft'", NL, "'EXT: warm'", NL, "'PULSES: 2+'", NL, "'NEURO: intact'", NL, "' '", NL,
    "CASE WHEN o_orderstatus <> 'P' THEN 'DISCHARGE PHYSICAL EXAM:' || chr(10) || 'Vitals - Tm 98.6, BP 82-98/42-68, HR 80-95, RR ___, O2 91-99% RA.' || chr(10) || 'General: well' || chr(10) || 'CV: regular' || chr(10) ELSE '' END",
    "'Pertinent Results:'", NL, "'ADMISSION LABS:'", NL,
    "'___ 10:25PM   WBC-'", WBC, "'# HGB-'", HGB, "'* CREAT-'", CREAT, "' SODIUM-'", NA, NL,
    "CASE WHEN o_orderstatus = 'F' THEN 'DISCHARGE LABS:' || chr(10) || '___ 06:00AM WBC-6.1 HGB-13.0' || chr(10) ELSE '' END",
    "'MICRO:'", NL, "'___ 10:00 am BLOOD CULTURE  (Final ___: no growth of '", _n(f"{K} % 6"), NL,
    "'IMAGING:'", NL, "'CXR: No acute process '", _n(f"{K} % 5"), "'.'", NL, "'U/S: Cholelithiasis and no ascites'", NL, "' '", NL,
    "'Brief Hospital Course:'", NL, "'___ Stable on day '", _n(f"{K} % 10"), "'. To schedule outpatient screening EGD soon.'", NL, "' '", NL,
    "'Transitional Issues:'", NL, "'# Code: '", "CASE WHEN o_orderstatus = 'F' THEN 'DNR' ELSE 'full' END", NL,
    "'- [ ] Follow-up peritoneal fluid culture'", NL, "'- [ ] New/changed medications: Furosemide '", DOSE, "' mg daily (new)'", NL, "' '", NL,
    "'Medications on Admission:'", NL, "'The Preadmission Medication list is accurate.'", NL, "'1. Furosemide 20 mg PO DAILY '", NL, "'2. Albuterol '", _n(f"{K} % 3 + 1"), "' PUFF IH Q4H'", NL, "' '", NL,
    "'Discharge Medications:'", NL, "'1. Furosemide '", DOSE, "' mg PO DAILY '", NL,
    "'RX *furosemide '", DOSE, "' mg 0.5 (One half) tablet(s) by mouth daily Disp #*30 Tablet Refills:*0'", NL,
    "'2. Acetaminophen 500 mg PO Q6H:PRN pain'", NL, "' '", NL,
    "'Discharge Disposition:'", NL, "CASE o_orderstatus WHEN 'F' THEN 'Home' ELSE 'Extended Care' END", NL, "' '", NL,
    "'Facility:'", NL, "CASE o_orderstatus WHEN 'F' THEN '___' ELSE 'Hill House' END", NL, "' '", NL,
    "'Discharge Diagnosis:'", NL, "'Primary: Ascites '", _n(f"{K} % 4"), NL, "'======='", NL,
    "CASE WHEN o_orderstatus = 'O' THEN 'SECONDARY DIAGNOSES' || chr(10) || 'Gout, Asthma' || chr(10) ELSE '' END", "' '", NL,
    "'Discharge Condition:'", NL, "'Mental Status: Clear and coherent.'", NL, "'Level of Consciousness: Alert '", _n(f"{K} % 2"), "'.'", NL,
    "'Activity Status: Ambulatory.'", NL, "' '", NL,
    "'Discharge Instructions:'", NL, "'Dear Ms. ___,'", NL, "'Rest well. You will follow up with clinic '", _n(f"{K} % 8"), "' soon. Goodbye'", NL, "' '", NL,
    "CASE WHEN o_orderstatus <> 'P' THEN 'Followup Instructions:' || chr(10) || '___' ELSE '' END",
]
TEXT = " || ".join(TEMPLATE)
VIEWS["notes"] = f"""
    SELECT 'N' || {_n(K)} AS note_id, o_custkey AS subject_id, o_orderkey AS hadm_id, {TEXT} AS text FROM orders"""
OF_ORDER = f"'N' || {_n(K)} AS note_id"


# Notes of a stored file, some megabytes of text, which is a task's share of reading them.
NOTES_PER_FILE = 5_000


def notes(v: Views) -> DataFrame:
    def build():
        # The text is made after the rows are spread, so many tasks read the notes later.
        # A number keeps the partitions from being joined again because the keys alone are small.
        files = v.table("orders").count() // NOTES_PER_FILE + 1
        return v.table("orders").repartition(files, "o_orderkey").select(
            F.expr(f"'N' || {_n(K)}").alias("note_id"),
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderkey").alias("hadm_id"),
            F.expr(TEXT).alias("text"),
        )

    return v.once("notes", build)


def read(v: Views, *parts: str) -> DataFrame:
    return job.read_notes(notes(v), parts)


def _s(struct: str, *path: str):
    c = F.col(f"`{struct}`")
    for p in path:
        c = c[p]
    return c


def _joined(c):
    return F.array_join(c, "; ")


CASE_F = "CASE o_orderstatus WHEN 'F' THEN {} WHEN 'O' THEN {} ELSE {} END"


@query(
    "n1_section_extract",
    f"SELECT {OF_ORDER}, {COMPLAINT} AS complaint, '' AS nothing, 'Mother with gout. She quit smoking ' || {_n(K + ' % 7 + 2')} || ' years ago.' AS family FROM orders",
)
def n1(v: Views) -> DataFrame:
    rules = {
        "complaint": N.R.SECTIONS["chief_complaint"],
        "nothing": ("No Such Heading:", "Physical Exam"),
        "family": N.R.SECTIONS["family_history"],
    }
    cut = N.with_sections(notes(v), "text", rules)
    return cut.select("note_id", *[F.col(f"s_{n}").alias(n) for n in rules])


@query(
    "n2_redaction",
    "SELECT doc_id, n, text IS NULL OR regexp_matches(text, '^[_ ]{0,3}$') AS redacted FROM (SELECT doc_id, 'word' AS n, split_part(text, ' ', 1) AS text FROM documents UNION ALL SELECT doc_id, 'mark', '___' FROM documents UNION ALL SELECT doc_id, 'short', '_ ' FROM documents UNION ALL SELECT doc_id, 'none', NULL FROM documents)",
)
def n2(v: Views) -> DataFrame:
    docs = v.table("documents")
    cases = {"word": F.split("text", " ")[0], "mark": F.lit("___"), "short": F.lit("_ "), "none": F.lit(None).cast("string")}
    out = None
    for name, text in cases.items():
        one = docs.select("doc_id", F.lit(name).alias("n"), N.redacted(text).alias("redacted"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "n3_admin_fields",
    f"""SELECT {OF_ORDER}, CAST(NULL AS VARCHAR) AS name, {SEX} AS sex, {SERVICE} AS service,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'Dr. Lee' END AS attending,
               CASE WHEN o_orderstatus = 'P' THEN '' ELSE {ALLERGY} END AS allergies FROM orders""",
)
def n3(v: Views) -> DataFrame:
    a = "Administrative Information"
    return read(v, "Administrative Information").select(
        "note_id", _s(a, "Name").alias("name"), _s(a, "Sex").alias("sex"), _s(a, "Service").alias("service"),
        _s(a, "Attending").alias("attending"), _joined(_s(a, "Allergies")).alias("allergies"),
    )


PAST = CASE_F.format("'HCV Cirrhosis: genotype three; COPD'", "'Asthma; Gout'", "'Diabetes; PTSD'")
SOCIAL = f"('Lives alone. Works nights. She quit smoking ' || {_n(K + ' % 7 + 2')} || ' years ago.')"
PROCEDURE = CASE_F.format("NULL", "'Paracentesis'", "'Paracentesis, Upper endoscopy'")


@query(
    "n4_clinical_summary",
    f"""SELECT {OF_ORDER}, {COMPLAINT} AS complaint, {PROCEDURE} AS procedures, {PAST} AS past, {SOCIAL} AS social,
               'Mother with gout.' AS family FROM orders""",
)
def n4(v: Views) -> DataFrame:
    a = "Clinical Summary"
    return read(v, "Clinical Summary").select(
        "note_id", _s(a, "Chief Complaint").alias("complaint"), _s(a, "Major Surgical or Invasive Procedure").alias("procedures"),
        _joined(_s(a, "Past Medical History")).alias("past"), _s(a, "Social History").alias("social"), _s(a, "Family History").alias("family"),
    )


VITALS = f"{TEMP} || '|' || {HR} || '|' || {SBP} || '/' || {DBP} || '|' || {RR} || '|' || {OX} || '%RA'"


def _vitals(*path: str):
    c = _s(*path)
    return F.concat_ws("|", *[F.coalesce(c[f], F.lit("-")) for f in N.R.VITAL_FIELDS])


@query(
    "n5_vitals_parse",
    f"""SELECT {OF_ORDER}, {VITALS} AS compact, {VITALS} AS vs, CASE WHEN o_orderstatus = 'P' THEN '-|-|-|-|-'
               ELSE '98.6|80-95|82-98/42-68|-|91-99% RA' END AS single FROM orders""",
)
def n5(v: Views) -> DataFrame:
    exam = "Physical Examination"
    return read(v, "History of Present Illness", "Physical Examination").select(
        "note_id", _vitals("History of Present Illness", "ED Findings", "Vitals").alias("compact"),
        _vitals(exam, "Admission Exam", "Vitals").alias("vs"), _vitals(exam, "Discharge Exam", "Vitals").alias("single"),
    )


@query(
    "n6_hpi",
    f"""SELECT {OF_ORDER}, 'presents with ' || {COMPLAINT} || ' and fever.' AS summary, 'Potassium=' || {POT} || ';Sodium=' || {NA} AS labs,
               'CXR showed a clear field ' || {_n(K + ' % 5')} AS imaging, 'Morphine Sulfate 5 mg IV; a GI cocktail' AS treatment FROM orders""",
)
def n6(v: Views) -> DataFrame:
    a = "History of Present Illness"
    labs = F.array_sort(F.map_entries(_s(a, "ED Labs")))
    return read(v, "History of Present Illness").select(
        "note_id", _s(a, "Summary").alias("summary"),
        F.array_join(F.transform(labs, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("labs"),
        _s(a, "ED Findings", "Imaging").alias("imaging"), _joined(_s(a, "ED Findings", "Initial Treatment")).alias("treatment"),
    )


EXAM = ["General", "HEENT", "Neck", "Lungs", "Cardiovascular", "Abdomen", "Extremities", "Skin", "Neuro"]


@query(
    "n7_physical_exam",
    f"""SELECT {OF_ORDER}, 'alert ' || {_n(K + ' % 4')} || '|clear|supple no nodes|clear|RRR ' || {HR} || '|soft|warm PULSES: 2+|-|intact' AS admission,
               CASE WHEN o_orderstatus = 'P' THEN '-|-|-|-|-|-|-|-|-' ELSE 'well|-|-|-|regular|-|-|-|-' END AS discharge FROM orders""",
)
def n7(v: Views) -> DataFrame:
    def parts(which: str):
        c = _s("Physical Examination", which)
        return F.concat_ws("|", *[F.coalesce(c[f], F.lit("-")) for f in EXAM])

    return read(v, "Physical Examination").select("note_id", parts("Admission Exam").alias("admission"), parts("Discharge Exam").alias("discharge"))


def _map_text(m):
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


ADMISSION_LABS = f"'CREAT=' || {CREAT} || ';HGB=' || {HGB} || '*;SODIUM=' || {NA} || ';WBC=' || {WBC} || '#'"


@query(
    "n8_lab_values",
    f"""SELECT {OF_ORDER}, {ADMISSION_LABS} AS labs FROM orders""",
)
def n8(v: Views) -> DataFrame:
    return read(v, "Pertinent Results").select("note_id", _map_text(_s("Pertinent Results", "Admission Labs")).alias("labs"))


@query(
    "n9_pertinent_results",
    f"""SELECT {OF_ORDER}, CASE WHEN o_orderstatus = 'F' THEN 'HGB=13.0;WBC=6.1' END AS discharge_labs,
               'BLOOD CULTURE (Final): no growth of ' || {_n(K + ' % 6')} AS micro,
               'CXR: No acute process ' || {_n(K + ' % 5')} || '.; U/S: Cholelithiasis and no ascites' AS imaging FROM orders""",
)
def n9(v: Views) -> DataFrame:
    studies = F.transform(F.col("`Imaging Studies`"), lambda s: F.concat_ws(": ", s["Study Type"], s["Findings"]))
    return read(v, "Pertinent Results", "Microbiology", "Imaging Studies").select(
        "note_id", _map_text(_s("Pertinent Results", "Discharge Labs")).alias("discharge_labs"),
        _s("Microbiology", "description").alias("micro"), _joined(studies).alias("imaging"),
    )


COURSE = f"""'Stable on day ' || {_n(K + ' % 10')} || '. To schedule outpatient screening EGD soon. Transitional Issues: # Code: '
    || CASE WHEN o_orderstatus = 'F' THEN 'DNR' ELSE 'full' END || ' - [ ] Follow-up peritoneal fluid culture - [ ] New/changed medications: Furosemide '
    || {DOSE} || ' mg daily (new)'"""


@query("n10_hospital_course", f"SELECT {OF_ORDER}, {COURSE} AS course FROM orders")
def n10(v: Views) -> DataFrame:
    return read(v, "Hospital Course").select("note_id", _s("Hospital Course", "description").alias("course"))


@query(
    "n11_transitional_issues",
    f"""SELECT {OF_ORDER}, CASE WHEN o_orderstatus = 'F' THEN 'DNR' ELSE 'full' END AS code_status,
               'Follow-up peritoneal fluid culture; Outpatient screening EGD' AS pending,
               'Furosemide ' || {DOSE} || ' mg daily; Acetaminophen 500 mg PO Q6H:PRN pain' AS started FROM orders""",
)
def n11(v: Views) -> DataFrame:
    a = "Transitional Issues"
    return read(v, "Transitional Issues").select(
        "note_id", _s(a, "Code Status").alias("code_status"), _joined(_s(a, "Pending Tests")).alias("pending"),
        _joined(_s(a, "Medication Changes", "Start")).alias("started"),
    )


ADM_MEDS = f"'Furosemide 20 mg PO DAILY; Albuterol ' || {_n(K + ' % 3 + 1')} || ' PUFF IH Q4H'"
DIS_MEDS = f"""'Furosemide ' || {DOSE} || ' mg PO DAILY RX *furosemide ' || {DOSE} ||
    ' mg 0.5 (One half) tablet(s) by mouth daily Disp #*30 Tablet Refills:*0; Acetaminophen 500 mg PO Q6H:PRN pain'"""


@query("n12_medications", f"SELECT {OF_ORDER}, {ADM_MEDS} AS admission, {DIS_MEDS} AS discharge FROM orders")
def n12(v: Views) -> DataFrame:
    a = "Medications"
    return read(v, "Medications").select("note_id", _joined(_s(a, "On Admission")).alias("admission"), _joined(_s(a, "On Discharge")).alias("discharge"))


SECOND = CASE_F.format("'HCV Cirrhosis; COPD; Cholelithiasis'", "'Gout; Asthma; Cholelithiasis'", "'PTSD; Cholelithiasis'")
TOLD = f"'Dear Ms. , Rest well. You will follow up with clinic ' || {_n(K + ' % 8')} || ' soon. Goodbye'"


@query(
    "n13_discharge_info",
    f"""SELECT {OF_ORDER}, CASE o_orderstatus WHEN 'F' THEN 'Home' ELSE 'Extended Care' END AS disposition,
               CASE WHEN o_orderstatus <> 'F' THEN 'Hill House' END AS facility, 'Ascites ' || {_n(K + ' % 4')} AS primary_dx,
               {SECOND} AS secondary_dx, 'Alert ' || {_n(K + ' % 2')} || '.' AS consciousness, {TOLD} AS instructions,
               'You will follow up with clinic ' || {_n(K + ' % 8')} || ' soon. Goodbye' AS followup FROM orders""",
)
def n13(v: Views) -> DataFrame:
    a = "Discharge Information"
    return read(v, "Discharge Information").select(
        "note_id", _s(a, "Disposition").alias("disposition"), _s(a, "Facility Name").alias("facility"),
        _joined(_s(a, "Primary Diagnoses")).alias("primary_dx"), _joined(_s(a, "Secondary Diagnoses")).alias("secondary_dx"),
        _s(a, "Condition", "Level of Consciousness").alias("consciousness"), _s(a, "Discharge Instructions").alias("instructions"),
        _s(a, "Follow-up").alias("followup"),
    )


# --- the jobs -------------------------------------------------------------------------


def json_notes(v: Views) -> DataFrame:
    """Two runs of the note job: the second takes only what the first left."""

    def run():
        path = f"{shared_dir(v.spark)}/note-documents-{uuid.uuid4().hex}"
        whole = notes(v)
        first = whole.where(F.col("text").contains("CHIEF COMPLAINT:"))
        done = job.note_job(first, None, path)
        return job.note_job(whole, done, path)

    return v.once("json_notes", run)


@query("n14_note_job", f"SELECT {OF_ORDER}, o_custkey AS subject_id, o_orderkey AS hadm_id, {SEX} AS sex FROM orders")
def n14(v: Views) -> DataFrame:
    sex = F.get_json_object("json_data", "$['Administrative Information'].Sex")
    return json_notes(v).select("note_id", "subject_id", "hadm_id", sex.alias("sex"))


FLAT = f"""SELECT {OF_ORDER}, {SEX} AS sex, {SERVICE} AS service, CASE WHEN o_orderstatus <> 'P' THEN {ALLERGY} END AS allergies,
    {COMPLAINT} AS chief_complaint, {PROCEDURE} AS major_procedure, replace({PAST}, '; ', ', ') AS past_medical_history,
    'Temperature: ' || {TEMP} || ', Heart Rate: ' || {HR} || ', Blood Pressure: ' || {SBP} || '/' || {DBP} || ', Respiratory Rate: ' || {RR}
      || ', SpO2: ' || {OX} || '%RA' AS vitals_once, 'WBC: ' || {WBC} || '#, Hemoglobin: ' || {HGB} || '*, Creatinine: ' || {CREAT} || ', Sodium: ' || {NA} AS admission_labs,
    CASE WHEN o_orderstatus = 'F' THEN 'WBC: 6.1, Hemoglobin: 13.0' END AS discharge_labs, 2 AS imaging_count, 'CXR, U/S' AS imaging_studies,
    replace({ADM_MEDS}, '; ', ', ') AS admission_medications, 'Ascites ' || {_n(K + ' % 4')} AS primary_diagnoses,
    replace({SECOND}, '; ', ', ') AS secondary_diagnoses, {_n(K + ' % 4')} AS exam FROM orders"""


@query(
    "n15_flatten_job",
    f"""SELECT * EXCLUDE (vitals_once, exam), vitals_once || ', ' || vitals_once || ', General: alert ' || exam AS admission_vitals FROM ({FLAT})""",
)
def n15(v: Views) -> DataFrame:
    return flat_notes(v).select(
        "note_id", "sex", "service", "allergies", "chief_complaint", "major_procedure", "past_medical_history", "admission_vitals",
        "admission_labs", "discharge_labs", "imaging_count", "imaging_studies", "admission_medications", "primary_diagnoses",
        "secondary_diagnoses",
    )


def flat_notes(v: Views) -> DataFrame:
    def run():
        return job.flatten_job(json_notes(v), None, f"{shared_dir(v.spark)}/note-flat-{uuid.uuid4().hex}")

    return v.once("flat_notes", run)


@query(
    "p20_json_fields",
    f"""SELECT {OF_ORDER}, {COURSE} AS hospital_course, CASE o_orderstatus WHEN 'F' THEN 'Home' ELSE 'Extended Care' END AS disposition,
               'Clear and coherent.' AS mental_status, {TOLD} AS discharge_instructions, replace({DIS_MEDS}, '; ', ', ') AS discharge_medications,
               CAST(NULL AS VARCHAR) AS antibiotic_plan FROM orders""",
)
def p20(v: Views) -> DataFrame:
    parts = job.parts_of(json_notes(v))
    return job.flatten(parts).select(
        "note_id", "hospital_course", "disposition", "mental_status", "discharge_instructions", "discharge_medications", "antibiotic_plan"
    )


@query(
    "p21_json_build",
    f"""SELECT {OF_ORDER}, 'Administrative Information,Clinical Summary,Discharge Information,History of Present Illness,Hospital Course,Imaging Studies,Medications,Microbiology,Pertinent Results,Physical Examination,Transitional Issues' AS sections,
               true AS keeps_nulls FROM orders""",
)
def p21(v: Views) -> DataFrame:
    keys = F.array_join(F.array_sort(F.json_object_keys("json_data")), ",")
    nulls = F.contains("json_data", F.lit('"Legal Guardian":null'))
    return json_notes(v).select("note_id", keys.alias("sections"), nulls.alias("keeps_nulls"))


@query(
    "f6_not_null_notes",
    f"SELECT {OF_ORDER}, {COMPLAINT} AS chief_complaint, {PROCEDURE} AS major_procedure FROM orders WHERE o_orderstatus <> 'F'",
)
def f6(v: Views) -> DataFrame:
    """Notes that have an admission and name a procedure."""
    kept = flat_notes(v).where(F.col("hadm_id").isNotNull() & F.col("major_procedure").isNotNull())
    return kept.select("note_id", "chief_complaint", "major_procedure")


@query(
    "j4_medication_changes",
    f"SELECT {OF_ORDER}, 'Started: Furosemide ' || {DOSE} || ' mg daily; Started: Acetaminophen 500 mg PO Q6H:PRN pain' AS changes FROM orders",
)
def j4(v: Views) -> DataFrame:
    from wardgraph.functions.text import split_list
    from wardgraph.operators.journey import medication_changes

    listed = [split_list(F.col(c)) for c in ["medications_started", "medications_stopped", "medications_to_avoid"]]
    return flat_notes(v).select("note_id", _joined(medication_changes(*listed)).alias("changes"))


@query(
    "n2_note_lines_cleaned",
    "SELECT conv_id, turn, trim(regexp_replace(replace(text, '___', ''), '\\s+', ' ', 'g')) AS text FROM conversations",
)
def n2_conversations(v: Views) -> DataFrame:
    return v.table("conversations").select("conv_id", "turn", clean(F.col("text")).alias("text"))


TURNS = "string_agg(role || ': ' || text, chr(10) ORDER BY turn)"


@query(
    "n1_conversation_sections",
    f"""WITH talks AS (SELECT conv_id, {TURNS} AS text FROM conversations GROUP BY conv_id)
        SELECT conv_id, CASE WHEN contains(text, 'assistant: ') THEN
               regexp_replace(split_part(regexp_replace(text, '^(?s:.*?)assistant:', ''), 'user:', 1), '^\\s+|\\s+$', '', 'g') ELSE '' END AS reply FROM talks""",
)
def n1_conversations(v: Views) -> DataFrame:
    """The first answer of a conversation, between the marks of its speakers."""
    rows = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    talks = v.table("conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["line"]), "\n").alias("text")
    )
    cut = N.with_sections(talks, "text", {"reply": ("assistant:", "user:")})
    return cut.select("conv_id", F.col("s_reply").alias("reply"))
