"""Notes to documents, documents to a flat table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.functions import note_rules as R
from wardgraph.functions import notes as N
from wardgraph.operators.upsert import only_new
from wardgraph.sources import files

ID_COLUMNS = ["note_id", "subject_id", "hadm_id", "note_type", "note_seq", "charttime", "storetime"]


def _ids(df: DataFrame) -> list[str]:
    return [c for c in ID_COLUMNS if c in df.columns]


PARTS = [
    "Administrative Information",
    "Clinical Summary",
    "History of Present Illness",
    "Physical Examination",
    "Pertinent Results",
    "Microbiology",
    "Imaging Studies",
    "Hospital Course",
    "Transitional Issues",
    "Medications",
    "Discharge Information",
]
# Sections each part is read from.
_NEEDS = {
    "Administrative Information": ["allergies"],
    "Clinical Summary": ["chief_complaint", "procedures", "past_history", "social_history", "family_history"],
    "History of Present Illness": ["hpi"],
    "Physical Examination": ["admission_exam", "discharge_exam"],
    "Pertinent Results": ["results"],
    "Microbiology": ["results"],
    "Imaging Studies": ["results"],
    "Hospital Course": [],
    "Transitional Issues": ["transitional", "course", "past_history", "discharge_meds"],
    "Medications": ["admission_meds", "discharge_meds"],
    "Discharge Information": [
        "primary_dx", "secondary_dx", "condition", "instructions", "followup", "course", "hpi", "past_history", "results",
    ],
}


def read_notes(notes: DataFrame, parts: Sequence[str] = PARTS) -> DataFrame:
    """Notes with one column per part of the document.

    The work is staged as columns: sections, then what needs them, then the
    parts. Every stage stays within the row, so there is no shuffle.
    """
    ids = _ids(notes)
    needed = {n: R.SECTIONS[n] for n in R.SECTIONS if any(n in _NEEDS[p] for p in parts)}
    seen = N.with_sections(notes.select(*ids, "text"), "text", needed)
    c = F.col
    if "results" in needed:
        seen = N.with_sections(seen.withColumnRenamed("s_results", "results"), "results", R.RESULT_SECTIONS)
        seen = seen.withColumn("studies", N.imaging_studies(c("s_imaging"), c("results")))
    if "Physical Examination" in parts:
        first, second = N.exam_texts(c("text"), c("s_admission_exam"), c("s_discharge_exam"))
        seen = seen.withColumns({"exam_1": first, "exam_2": second})
    if "Discharge Information" in parts:
        seen = seen.withColumn("told", F.concat_ws(" ", "s_course", "s_hpi", "s_past_history"))

    def labs(section: str):
        return F.when(c(section) != "", N.lab_values(c(section)))

    makers = {
        "Administrative Information": lambda: N.head(c("text"), c("s_allergies")),
        "Clinical Summary": lambda: N.summary(*[c(f"s_{n}") for n in _NEEDS["Clinical Summary"]]),
        "History of Present Illness": lambda: N.hpi(c("s_hpi")),
        "Physical Examination": lambda: F.struct(
            N.exam(c("exam_1")).alias("Admission Exam"), N.exam(c("exam_2")).alias("Discharge Exam")
        ),
        "Pertinent Results": lambda: F.struct(
            F.coalesce(labs("s_admission_labs"), N.lab_values(c("results"))).alias("Admission Labs"),
            labs("s_discharge_labs").alias("Discharge Labs"),
        ),
        "Microbiology": lambda: F.struct(N.microbiology(c("s_microbiology")).alias("description")),
        "Imaging Studies": lambda: c("studies"),
        "Hospital Course": lambda: F.struct(N.hospital_course(c("text")).alias("description")),
        "Transitional Issues": lambda: N.transitional(*[c(f"s_{n}") for n in _NEEDS["Transitional Issues"]]),
        "Medications": lambda: F.struct(
            N.admission_medications(c("s_admission_meds")).alias("On Admission"),
            N.discharge_medications(c("s_discharge_meds")).alias("On Discharge"),
        ),
        "Discharge Information": lambda: N.discharge(
            c("text"), *[c(f"s_{n}") for n in ("primary_dx", "secondary_dx", "condition", "instructions", "followup")],
            c("told"), c("studies"),
        ),
    }
    return seen.select(*ids, *[makers[p]().alias(p) for p in PARTS if p in parts])


def documents(parts: DataFrame) -> DataFrame:
    """The parts of ``read_notes`` as one JSON document per note, nulls kept."""
    ids = _ids(parts)
    body = F.struct(*[F.col(c) for c in parts.columns if c not in ids])
    return parts.select(*ids, F.to_json(body, {"ignoreNullFields": "false"}).alias("json_data"))


def parts_of(docs: DataFrame) -> DataFrame:
    """JSON documents taken apart into the columns of ``read_notes``."""
    ids = _ids(docs)
    schema = read_notes(docs.select(*ids, F.lit("").alias("text"))).drop(*ids).schema
    return docs.select(*ids, F.from_json("json_data", schema).alias("d")).select(*ids, "d.*")


def flatten(parts: DataFrame) -> DataFrame:
    """The flat table of the notes: identifiers and 32 fields."""
    ids = _ids(parts)
    admin, said, hpi, exam = (
        F.col("`Administrative Information`"), F.col("`Clinical Summary`"), F.col("`History of Present Illness`"),
        F.col("`Physical Examination`"),
    )
    moves, meds, left = F.col("`Transitional Issues`"), F.col("Medications"), F.col("`Discharge Information`")
    changes = moves["Medication Changes"]

    def joined(items):
        return F.nullif(F.array_join(items, ", "), F.lit(""))

    def shown(struct, names):
        return [F.concat(F.lit(f"{n}: "), struct[n]) for n in names]

    def named(labs, fields):
        return [F.concat(F.lit(f"{n}: "), F.coalesce(*[F.try_element_at(labs, F.lit(k)) for k in keys])) for n, keys in fields.items()]

    def listed(parts_):
        return F.nullif(F.concat_ws(", ", *parts_), F.lit(""))

    first, second = exam["Admission Exam"], exam["Discharge Exam"]
    general = lambda e: F.concat(F.lit("General: "), e["General"])
    fields = {
        "sex": admin["Sex"],
        "service": admin["Service"],
        "allergies": joined(admin["Allergies"]),
        "chief_complaint": said["Chief Complaint"],
        "major_procedure": said["Major Surgical or Invasive Procedure"],
        "past_medical_history": joined(said["Past Medical History"]),
        "social_history": said["Social History"],
        "family_history": said["Family History"],
        "hpi_summary": hpi["Summary"],
        "admission_vitals": listed(
            [*shown(hpi["ED Findings"]["Vitals"], R.VITAL_FIELDS), *shown(first["Vitals"], R.VITAL_FIELDS), general(first)]
        ),
        "discharge_vitals": listed([*shown(second["Vitals"], R.VITAL_FIELDS), general(second)]),
        "admission_labs": listed(named(F.col("`Pertinent Results`")["Admission Labs"], R.ADMISSION_LAB_FIELDS)),
        "discharge_labs": listed(named(F.col("`Pertinent Results`")["Discharge Labs"], R.DISCHARGE_LAB_FIELDS)),
        "microbiology_findings": F.col("Microbiology")["description"],
        "imaging_count": F.size("`Imaging Studies`"),
        "imaging_studies": joined(F.transform("`Imaging Studies`", lambda s: s["Study Type"])),
        "hospital_course": F.col("`Hospital Course`")["description"],
        "antibiotic_plan": moves["Antibiotic Plan"],
        "code_status": moves["Code Status"],
        "medications_started": joined(changes["Start"]),
        "medications_stopped": joined(changes["Stop"]),
        "medications_to_avoid": joined(changes["Avoid"]),
        "admission_medications": joined(meds["On Admission"]),
        "discharge_medications": joined(meds["On Discharge"]),
        "disposition": left["Disposition"],
        "facility_name": left["Facility Name"],
        "primary_diagnoses": joined(left["Primary Diagnoses"]),
        "secondary_diagnoses": joined(left["Secondary Diagnoses"]),
        "mental_status": left["Condition"]["Mental Status"],
        "level_of_consciousness": left["Condition"]["Level of Consciousness"],
        "activity_status": left["Condition"]["Activity Status"],
        "discharge_instructions": left["Discharge Instructions"],
    }
    return parts.select(*ids, *[v.alias(k) for k, v in fields.items()])


def note_job(notes: DataFrame, done: DataFrame | None, path: str) -> DataFrame:
    """Read the notes that have no document yet and append their documents."""
    fresh = notes if done is None else only_new(notes, done, ["note_id"])
    made = documents(read_notes(fresh))
    files.append(made, path)
    return made.sparkSession.read.schema(made.schema).parquet(path)


def flatten_job(docs: DataFrame, done: DataFrame | None, path: str) -> DataFrame:
    """Flatten the documents that are not flattened yet and append their rows."""
    fresh = docs if done is None else only_new(docs, done, ["note_id"])
    made = flatten(parts_of(fresh))
    files.append(made, path)
    return made.sparkSession.read.schema(made.schema).parquet(path)
