"""Nodes and edges from the flattened discharge notes, all in one pass over the notes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgraph.functions.text import allergies, split_list, vitals_map

# List nodes: label, owner, edge, column of the note, payload column.
LISTS = [
    ("AdmissionLabs", "HospitalAdmission", "INCLUDED_LAB_RESULTS", "admission_labs", "lab_tests"),
    ("DischargeLabs", "DischargeClinicalNote", "RECORDED_LAB_RESULTS", "discharge_labs", "lab_tests"),
    ("AdmissionMedications", "HospitalAdmission", "INCLUDED_MEDICATIONS", "admission_medications", "medications"),
    ("DischargeMedications", "DischargeClinicalNote", "RECORDED_MEDICATIONS", "discharge_medications", "medications"),
    ("MedicationStarted", "Discharge", "STARTED_MEDICATIONS", "medications_started", "medications"),
    ("MedicationStopped", "Discharge", "STOPPED_MEDICATIONS", "medications_stopped", "medications"),
    ("MedicationToAvoid", "Discharge", "LISTED_MEDICATIONS_TO_AVOID", "medications_to_avoid", "medications"),
]
VITALS = [
    ("AdmissionVitals", "HospitalAdmission", "admission_vitals"),
    ("DischargeVitals", "DischargeClinicalNote", "discharge_vitals"),
]
NOTE_FIELDS = [
    "hospital_course", "antibiotic_plan", "code_status", "microbiology_findings", "imaging_studies", "disposition",
    "facility_name", "mental_status", "level_of_consciousness", "activity_status", "discharge_instructions",
]
ADMISSION_FIELDS = ["sex", "service", "chief_complaint", "social_history", "family_history"]
DISCHARGE_FIELDS = ["note_id", "disposition", "facility_name", "allergies", "major_procedure"]


def add_note_facts(g, t: Mapping[str, DataFrame], stays: DataFrame | None) -> None:
    """Add what the notes say. A note counts only where its admission is the patient's."""
    known = t["admissions"].select("hadm_id", "subject_id")
    notes = t["notes_flat"].where(F.col("hadm_id").isNotNull()).join(known, ["hadm_id", "subject_id"], "left_semi")
    if stays is not None:
        ends = stays.where(F.col("label") == "Discharge").select(
            "subject_id", "hadm_id", F.col("event_id").alias("_discharge")
        )
        notes = notes.join(ends, ["subject_id", "hadm_id"], "left")
    else:
        notes = notes.withColumn("_discharge", F.lit(None).cast("string"))
    notes = g.save(notes, "notes")
    per_admission = notes.withColumn("key", F.col("hadm_id").cast("string"))
    owner_key: dict[str, Column] = {
        "HospitalAdmission": F.col("hadm_id"),
        "Discharge": F.col("_discharge"),
        "DischargeClinicalNote": F.col("note_id"),
    }

    def present(*columns: str) -> DataFrame:
        return per_admission.where(F.coalesce(*[F.col(c) for c in columns]).isNotNull())

    def add(label: str, owner: str, rel: str, rows: DataFrame, payload: list) -> None:
        rows = rows.where(owner_key[owner].isNotNull())
        g.add(label, rows.select("key", "subject_id", "hadm_id", "note_id", F.lit(label).alias("name"), *payload).dropDuplicates(["key"]))
        g.link(rows, owner, owner_key[owner], rel, label, F.col("key"))

    noted = notes.withColumn("key", F.col("note_id"))
    add("DischargeClinicalNote", "Discharge", "DOCUMENTED_IN_NOTE", noted, [F.col(c) for c in NOTE_FIELDS])
    history = ["past_medical_history", "social_history", "family_history"]
    add("PatientPastHistory", "HospitalAdmission", "INCLUDED_PAST_HISTORY", present(*history), [F.col(c) for c in history])
    add("HPISummary", "HospitalAdmission", "INCLUDED_HPI_SUMMARY", present("hpi_summary"), [F.col("hpi_summary").alias("summary")])

    allergic = notes.withColumn("allergy_name", F.explode(allergies(F.col("allergies")))).withColumn(
        "key", F.concat_ws("@", "allergy_name", F.col("hadm_id").cast("string"))
    )
    add("AllergyIdentified", "Discharge", "HAS_ALLERGY", allergic, [F.col("allergy_name")])
    for label, owner, c in VITALS:
        rows = present(c).withColumn("vitals", vitals_map(F.col(c))).withColumn("key", F.col("note_id"))
        add(label, owner, "RECORDED_VITALS", rows.where(F.size("vitals") > 0), [F.col("vitals")])
    for label, owner, rel, c, payload in LISTS:
        rows = present(c).withColumn(payload, split_list(F.col(c))).withColumn("key", F.col("note_id"))
        add(label, owner, rel, rows.where(F.size(payload) > 0), [F.col(payload)])

    dx = present("primary_diagnoses", "secondary_diagnoses").where(F.col("_discharge").isNotNull())
    dx = dx.withColumns(
        {
            "key": F.concat(F.col("_discharge"), F.lit("@note")),
            "event_id": F.col("_discharge"),
            "primary_diagnoses": split_list(F.col("primary_diagnoses")),
            "secondary_diagnoses": split_list(F.col("secondary_diagnoses")),
        }
    )
    g.add(
        "Diagnosis",
        dx.select("key", "subject_id", "hadm_id", "event_id", "primary_diagnoses", "secondary_diagnoses", F.lit("Diagnosis").alias("name")).dropDuplicates(["key"]),
    )
    g.link(dx, "Discharge", F.col("_discharge"), "RECORDED_DIAGNOSES", "Diagnosis", F.col("key"))

    # The admission and the discharge gain what the note adds to them.
    def first_note(columns: list[str], by: str) -> DataFrame:
        row = F.struct(*columns)
        return notes.where(F.col(by).isNotNull()).groupBy(by).agg(F.min_by(row, "note_id").alias("_n")).select(by, "_n.*")

    admission_part = first_note(ADMISSION_FIELDS, "hadm_id")
    frame = g.frames["HospitalAdmission"]
    g.frames["HospitalAdmission"] = frame.join(admission_part, "hadm_id", "left")
    if "Discharge" in g.frames:
        part = first_note(DISCHARGE_FIELDS, "_discharge").withColumnRenamed("_discharge", "event_id")
        g.frames["Discharge"] = g.frames["Discharge"].join(part, "event_id", "left")
