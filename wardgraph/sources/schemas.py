"""Column types of the hospital tables, one line per table.

Codes are text, because a code read as a number loses its leading zeros.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

HOSP = {
    "patients": "subject_id bigint, gender string, anchor_age int, anchor_year int, anchor_year_group string, dod string",
    "admissions": "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, admission_type string, admit_provider_id string, admission_location string, discharge_location string, insurance string, language string, marital_status string, race string, edregtime timestamp_ntz, edouttime timestamp_ntz, hospital_expire_flag int",
    "transfers": "subject_id bigint, hadm_id bigint, transfer_id bigint, eventtype string, careunit string, intime timestamp_ntz, outtime timestamp_ntz",
    "services": "subject_id bigint, hadm_id bigint, transfertime timestamp_ntz, prev_service string, curr_service string",
    "prescriptions": "subject_id bigint, hadm_id bigint, poe_id string, starttime timestamp_ntz, stoptime timestamp_ntz, drug string, dose_val_rx string, dose_unit_rx string, route string, doses_per_24_hrs double",
    "microbiologyevents": "microevent_id bigint, subject_id bigint, hadm_id bigint, micro_specimen_id bigint, charttime timestamp_ntz, spec_type_desc string, test_name string, org_name string, ab_name string, dilution_value double, interpretation string, comments string",
    "drgcodes": "subject_id bigint, hadm_id bigint, drg_type string, drg_code string, description string, drg_severity double, drg_mortality double",
    "labevents": "labevent_id bigint, subject_id bigint, hadm_id bigint, itemid bigint, charttime timestamp_ntz, valuenum double, valueuom string, ref_range_lower double, ref_range_upper double, flag string",
    "d_labitems": "itemid bigint, label string, fluid string, category string",
    "diagnoses_icd": "subject_id bigint, hadm_id bigint, seq_num int, icd_code string, icd_version string",
    "d_icd_diagnoses": "icd_code string, icd_version string, long_title string",
    "procedures_icd": "subject_id bigint, hadm_id bigint, seq_num int, chartdate date, icd_code string, icd_version string",
    "d_icd_procedures": "icd_code string, icd_version string, long_title string",
}
ICU = {
    "icustays": "subject_id bigint, hadm_id bigint, stay_id bigint, first_careunit string, last_careunit string, intime timestamp_ntz, outtime timestamp_ntz, los double",
    "procedureevents": "subject_id bigint, hadm_id bigint, stay_id bigint, itemid bigint, starttime timestamp_ntz, endtime timestamp_ntz, value double, valueuom string, ordercategoryname string, ordercategorydescription string",
    "chartevents": "subject_id bigint, hadm_id bigint, stay_id bigint, itemid bigint, charttime timestamp_ntz, value string, valuenum double, valueuom string",
    "d_items": "itemid bigint, label string, category string, unitname string, param_type string, lownormalvalue double, highnormalvalue double",
}
ED = {
    "edstays": "subject_id bigint, hadm_id bigint, stay_id bigint, intime timestamp_ntz, outtime timestamp_ntz, disposition string, arrival_transport string",
    "medrecon": "subject_id bigint, stay_id bigint, charttime timestamp_ntz, name string, etcdescription string",
    "pyxis": "subject_id bigint, stay_id bigint, charttime timestamp_ntz, med_rn int, name string",
    "triage": "subject_id bigint, stay_id bigint, temperature double, heartrate double, resprate double, o2sat double, sbp double, dbp double, pain string, acuity double, chiefcomplaint string",
    "diagnosis": "subject_id bigint, stay_id bigint, seq_num int, icd_code string, icd_version string, icd_title string",
}
NOTE = {
    "discharge": "note_id string, subject_id bigint, hadm_id bigint, note_type string, note_seq int, charttime timestamp_ntz, storetime timestamp_ntz, text string",
}

# Tables that only pass through the cohort cut; their columns are read as text.
PASSED_THROUGH = {
    "hosp": ["omr", "pharmacy", "poe", "poe_detail", "emar", "emar_detail", "hcpcsevents", "d_hcpcs", "provider"],
    "icu": ["outputevents", "datetimeevents", "inputevents", "ingredientevents", "caregiver"],
    "ed": ["vitalsign"],
}

CATALOG: dict[str, dict[str, str | None]] = {
    "hosp": {**HOSP, **dict.fromkeys(PASSED_THROUGH["hosp"])},
    "icu": {**ICU, **dict.fromkeys(PASSED_THROUGH["icu"])},
    "ed": {**ED, **dict.fromkeys(PASSED_THROUGH["ed"])},
    "note": dict(NOTE),
}

TRACKER = "subject_id bigint, script_name string, processed_at timestamp_ntz, status string"
NOTES_JSON = "note_id string, subject_id bigint, hadm_id bigint, note_type string, note_seq int, charttime timestamp_ntz, storetime timestamp_ntz, json_data string"


def schema(module: str, table: str) -> StructType | None:
    """Declared columns of a table; null for one that is only passed through."""
    ddl = CATALOG[module][table]
    return None if ddl is None else StructType.fromDDL(ddl)
