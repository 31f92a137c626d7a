"""Walks against plain searches, rules, and the whole build."""

import random
from datetime import date, datetime

import pytest

from wardgraph.operators import graph, journey, nodes, quality
from wardgraph.plans.build import build, load_graph, save_graph

EDGES = "src_label string, src_key string, rel string, dst_label string, dst_key string, subject_id bigint"


def frame(spark, pairs):
    return spark.createDataFrame([("N", a, "R", "N", b, 1) for a, b in pairs], EDGES)


def roots(spark, keys):
    return spark.createDataFrame([(f"N|{k}",) for k in keys], "root string")


def plain_reach(pairs, keys):
    out = set()
    for root in keys:
        seen, front = {root}, [root]
        while front:
            front = [b for a, b in pairs if a in front and b not in seen]
            seen |= set(front)
        out |= {(f"N|{root}", f"N|{n}") for n in seen}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_reach_equals_a_search(spark, seed):
    rnd = random.Random(seed)
    names = [str(i) for i in range(40)]
    pairs = {(rnd.choice(names), rnd.choice(names)) for _ in range(35 + 10 * seed)}
    chain = [(f"c{i}", f"c{i + 1}") for i in range(50)]
    pairs = sorted(pairs | set(chain) | {("0", "c0"), ("r1", "r2"), ("r2", "r1")})
    starts = ["0", "7", "c20", "r1"]
    got = graph.reachable(frame(spark, pairs), roots(spark, starts)).collect()
    assert set(map(tuple, got)) == plain_reach(pairs, starts)
    assert len(got) == len(set(map(tuple, got)))


def test_only_nodes_that_lead_on_take_part_in_the_rounds(spark, monkeypatch):
    """A hundred leaves look up the head of their parent once; leaves of a closed ring have none."""
    rows = []
    whole = graph.written

    def counted(df, name="stage", partition_by=None):
        made = whole(df, name, partition_by)
        rows.append((name, made.count()))
        return made

    monkeypatch.setattr(graph, "written", counted)
    pairs = [("r", "a"), ("a", "b"), ("x", "y"), ("y", "x"), ("y", "far")] + [("b", f"leaf{i}") for i in range(100)]
    got = graph.reachable(frame(spark, pairs), roots(spark, ["r", "r"])).collect()
    assert sorted(map(tuple, got)) == sorted(plain_reach(pairs, ["r"]))
    assert all(n < 10 for name, n in rows if name == "chains" and n != 105)
    assert [n for name, n in rows if name == "chains"].count(105) == 1


def test_links_both_ways_are_written_one_way(spark, monkeypatch):
    rows = []
    whole = graph.written

    def counted(df, name="stage", partition_by=None):
        made = whole(df, name, partition_by)
        rows.append((name, made.count()))
        return made

    monkeypatch.setattr(graph, "written", counted)
    pairs = [("p", "a"), ("a", "p"), ("q", "a"), ("q", "b"), ("b", "c"), ("c", "d")]
    got = graph.within(frame(spark, pairs), roots(spark, ["p"]), 3).collect()
    assert sorted(map(tuple, got)) == [("N|p", "N|a", 1), ("N|p", "N|b", 3), ("N|p", "N|p", 0), ("N|p", "N|q", 2)]
    assert dict(rows)["links"] == 6


def test_diamond_and_inbound_edge(spark):
    pairs = [("p", "a"), ("p", "b"), ("a", "c"), ("b", "c"), ("provider", "c")]
    got = graph.reachable(frame(spark, pairs), roots(spark, ["p"])).collect()
    assert sorted(r.node for r in got) == ["N|a", "N|b", "N|c", "N|p"]
    both = graph.reachable(frame(spark, pairs), roots(spark, ["p"]), directed=False).collect()
    assert "N|provider" in {r.node for r in both}


def test_rules(spark):
    rows = [
        ("UnitAdmission", "1", "INCLUDED_LAB_EVENTS", "LabEvents", "1", 1),
        ("LabEvents", "1", "CONTAINED_MICROBIOLOGY_EVENT", "MicrobiologyEvent", "2", 1),
        ("LabEvents", "1", "HAS", "Prescription", "3", 1),
        ("UnitAdmission", "1", "RECORDED_CHART_EVENTS", "ChartEventBatch", "1", 1),
        ("ICUStay", "1", "RECORDED_CHART_EVENTS", "ChartEventBatch", "1", 1),
        ("Diagnosis", "1", "X", "LabEvents", "1", 1),
    ]
    edges = spark.createDataFrame(rows, EDGES)
    assert {(r.src_label, r.rule) for r in quality.violations(edges).collect()} == {
        ("LabEvents", "labs to prescriptions"), ("UnitAdmission", "parent of ChartEventBatch"), ("Diagnosis", "parent of LabEvents"),
    }
    assert quality.delete_violations(edges).count() == 3


def t(day, hour=0):
    return datetime(2150, 1, day, hour)


@pytest.fixture(scope="module")
def tables(spark):
    def df(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return {
        "patients": df("subject_id bigint, gender string, anchor_age int, dod string", (1, "F", 60, None), (2, "M", 50, None)),
        "admissions": df(
            "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz, admission_type string, admit_provider_id string",
            (1, 10, t(1, 9), t(4), "URGENT", " P1 "),
        ),
        "transfers": df(
            "subject_id bigint, hadm_id bigint, transfer_id bigint, eventtype string, careunit string, intime timestamp_ntz, outtime timestamp_ntz",
            (1, 10, 100, "ed", "ED", t(1, 8), t(1, 10)), (1, 10, 101, "admit", "Med", t(1, 10), t(2)), (1, 10, 102, "transfer", "MICU", t(2), t(3)),
            (1, 10, 103, "transfer", "MICU", t(3), t(4)), (1, 10, 104, "discharge", None, t(4), None), (1, None, 105, "ed", "ED", t(9), t(9, 5)),
        ),
        "services": df("subject_id bigint, hadm_id bigint, transfertime timestamp_ntz, curr_service string", (1, 10, t(1, 10), "MED")),
        "edstays": df(
            "subject_id bigint, hadm_id bigint, stay_id bigint, intime timestamp_ntz, outtime timestamp_ntz, disposition string, arrival_transport string",
            (1, 10, 100, t(1, 8), t(1, 10), "ADMITTED", "WALK IN"), (2, None, 200, t(1), t(1, 4), "HOME", "AMBULANCE"),
        ),
        "icustays": df(
            "subject_id bigint, hadm_id bigint, stay_id bigint, first_careunit string, last_careunit string, los double", (1, 10, 102, "MICU", "MICU", 2.0)
        ),
        "prescriptions": df(
            "subject_id bigint, hadm_id bigint, poe_id string, starttime timestamp_ntz, drug string, dose_val_rx string, dose_unit_rx string, route string, doses_per_24_hrs double",
            (1, 10, "x", t(1, 12), "Drug A", "5", "mg", "PO", 2.0), (1, 10, "x", t(1, 12), "Drug A", "5", "mg", "PO", 2.0), (1, 10, "y", t(1, 12), "Drug B", None, None, None, None),
        ),
        "medrecon": df("subject_id bigint, stay_id bigint, charttime timestamp_ntz, name string, etcdescription string", (1, 100, t(1, 8), "Aspirin", None)),
        "pyxis": df("subject_id bigint, stay_id bigint, charttime timestamp_ntz, name string", (1, 100, t(1, 9), "Heparin")),
        "triage": df("subject_id bigint, stay_id bigint, temperature double, pain string, chiefcomplaint string", (1, 100, 98.6, "3", "Chest pain")),
        "ed_diagnosis": df("subject_id bigint, stay_id bigint, seq_num int, icd_title string", (1, 100, 1, "CHEST PAIN"), (1, 100, 2, "HTN")),
        "procedures_icd": df(
            "subject_id bigint, hadm_id bigint, chartdate date, icd_code string, icd_version string",
            (1, 10, date(2150, 1, 2), "0042", "9"), (1, 10, date(2150, 1, 1), "0043", "9"),
        ),
        "d_icd_procedures": df("icd_code string, icd_version string, long_title string", ("0042", "9", "Tube")),
        "procedureevents": df(
            "subject_id bigint, hadm_id bigint, stay_id bigint, itemid bigint, starttime timestamp_ntz, value double, valueuom string, ordercategoryname string, ordercategorydescription string",
            (1, 10, 102, 5, t(2, 3), 1.0, "h", "Vent", "Task"), (1, 10, 102, 5, t(2, 4), 1.0, "h", "Vent", "Drug"),
        ),
        "d_items": df(
            "itemid bigint, label string, category string, unitname string, param_type string, lownormalvalue double, highnormalvalue double",
            (5, "Item", "c", "u", "Numeric", 1.0, 2.0),
        ),
        "diagnoses_icd": df("subject_id bigint, hadm_id bigint, seq_num int, icd_code string, icd_version string", (1, 10, 2, "B", "9"), (1, 10, 1, "A", "9")),
        "d_icd_diagnoses": df("icd_code string, icd_version string, long_title string", ("A", "9", "htn"), ("B", "9", "Sepsis")),
        "labevents": df(
            "labevent_id bigint, subject_id bigint, hadm_id bigint, itemid bigint, charttime timestamp_ntz, valuenum double, valueuom string, ref_range_lower double, ref_range_upper double, flag string",
            (1, 1, 10, 7, t(2), 5.0, "mg", 1.0, 2.0, None), (2, 1, None, 7, t(2), 5.0, "mg", 1.0, 2.0, None),
        ),
        "d_labitems": df("itemid bigint, label string, fluid string, category string", (7, "Na", "Blood", "Chem")),
        "microbiologyevents": df(
            "microevent_id bigint, subject_id bigint, hadm_id bigint, micro_specimen_id bigint, charttime timestamp_ntz, spec_type_desc string, test_name string, org_name string, ab_name string, dilution_value double, interpretation string, comments string",
            (1, 1, 10, 50, t(2, 1), "BLOOD", "CULTURE", None, None, None, None, "none"), (2, 1, 10, None, t(2, 1), "X", "Y", None, None, None, None, None),
        ),
        "drgcodes": df(
            "subject_id bigint, hadm_id bigint, drg_type string, drg_code string, description string, drg_severity double, drg_mortality double",
            (1, 10, "APR", "720", "Sepsis", 3.0, None), (2, 10, "APR", "721", "wrong patient", None, None),
        ),
        "chartevents": df(
            "subject_id bigint, hadm_id bigint, itemid bigint, charttime timestamp_ntz, value string, valuenum double, valueuom string",
            (1, 10, 5, t(2, 5), None, 3.0, None), (1, 10, 5, t(1, 11), None, 3.0, None),
        ),
        "notes_flat": df(
            "note_id string, subject_id bigint, hadm_id bigint, " + ", ".join(f"{c} string" for c in NOTE_FIELDS),
            tuple(["n1", 1, 10] + [NOTE.get(c) for c in NOTE_FIELDS]),
        ),
    }


NOTE_FIELDS = """sex service allergies chief_complaint major_procedure past_medical_history social_history family_history hpi_summary
admission_vitals discharge_vitals admission_labs discharge_labs microbiology_findings imaging_studies hospital_course antibiotic_plan
code_status medications_started medications_stopped medications_to_avoid admission_medications discharge_medications disposition
facility_name primary_diagnoses secondary_diagnoses mental_status level_of_consciousness activity_status discharge_instructions""".split()
NOTE = {
    "sex": "F", "allergies": "Penicillin and Sulfa", "chief_complaint": "fever", "hpi_summary": "came in", "admission_vitals": "Heart Rate: 80",
    "discharge_labs": "WBC: 5", "medications_started": "A, B", "primary_diagnoses": "Sepsis", "secondary_diagnoses": "Gout", "disposition": "Home",
    "past_medical_history": "Asthma", "admission_medications": "C",
}


@pytest.fixture(scope="module")
def built(spark, tables, tmp_path_factory):
    made, path = build(tables), str(tmp_path_factory.mktemp("graph"))
    save_graph(made, path)
    return load_graph(spark, path, made.frames)


def test_build(built):
    all_nodes = {(r.label, r.key) for r in built.nodes().collect()}
    edges = {(r.src_label, r.src_key, r.rel, r.dst_label, r.dst_key) for r in built.edges().collect()}
    for e in [
        ("Patient", "1", "VISITED_ED", "EmergencyDepartment", "100"),
        ("Patient", "2", "VISITED_ED", "EmergencyDepartment", "200"),
        ("EmergencyDepartment", "100", "LED_TO_UNIT_ADMISSION", "UnitAdmission", "101"),
        ("UnitAdmission", "101", "LED_TO_UNIT_ADMISSION", "ICUStay", "102"),
        ("ICUStay", "102", "LED_TO_DISCHARGE", "Discharge", "104"),
        ("EmergencyDepartment", "100", "LED_TO_ADMISSION_DURING_STAY", "HospitalAdmission", "10"),
        ("Discharge", "104", "LED_TO_ED_VISIT", "EmergencyDepartment", "105"),
        ("UnitAdmission", "101", "ISSUED_PRESCRIPTIONS", "PrescriptionsBatch", "101"),
        ("ICUStay", "102", "RECORDED_CHART_EVENTS", "ChartEventBatch", "102"),
        ("ICUStay", "102", "INCLUDED_PROCEDURES", "ProceduresBatch", "102"),
        ("LabEvents", "102", "CONTAINED_MICROBIOLOGY_EVENT", "MicrobiologyEvent", "102@50@2150-01-02 01:00:00"),
        ("Provider", "P1@1", "MANAGED_ADMISSION", "HospitalAdmission", "10"),
        ("HospitalAdmission", "10", "WAS_ASSIGNED_DRG_CODE", "DRG", "10_APR_720"),
        ("EmergencyDepartment", "100", "INCLUDED_TRIAGE_ASSESSMENT", "InitialAssessment", "100"),
        ("Discharge", "104", "RECORDED_DIAGNOSES", "Diagnosis", "104"),
        ("Discharge", "104", "HAS_ALLERGY", "AllergyIdentified", "Sulfa@10"),
        ("Discharge", "104", "STARTED_MEDICATIONS", "MedicationStarted", "n1"),
        ("DischargeClinicalNote", "n1", "RECORDED_LAB_RESULTS", "DischargeLabs", "n1"),
        ("HospitalAdmission", "10", "RECORDED_VITALS", "AdmissionVitals", "n1"),
        ("HospitalAdmission", "10", "INCLUDED_PAST_HISTORY", "PatientPastHistory", "10"),
    ]:
        assert e in edges, e
    for src_label, src, _, dst_label, dst in edges:
        assert (src_label, src) in all_nodes, (src_label, src)
        assert (dst_label, dst) in all_nodes, (dst_label, dst)
    assert not any("721" in k for _, k in all_nodes)
    # The second result falls on the boundary of two stays and has no admission in one copy.
    assert {k for label, k in all_nodes if label == "LabEvent"} == {"101@2150-01-02 00:00:00", "102@2150-01-02 00:00:00"}


def test_build_keeps_rules_and_counts(built):
    report = quality.report(built.nodes(), built.edges())
    assert report["violations"].count() == 0
    assert report["dangling"].count() == 0
    for label, items, count in [("Prescription", "medicines", "medicine_count"), ("LabEvent", "lab_results", "lab_count")]:
        for r in built.frames[label].collect():
            assert len(r[items]) == r[count]
    keys = built.nodes().groupBy("label", "key").count().where("count > 1").count()
    assert keys == 0


def test_build_values(built):
    patient = {r.subject_id: r for r in built.frames["Patient"].collect()}
    assert patient[1].all_diagnoses == ["htn", "Sepsis", "CHEST PAIN", "Gout"]
    assert (patient[1].total_number_of_admissions, patient[2].total_number_of_admissions) == (1, 0)
    assert built.frames["InitialAssessment"].head()["chiefcomplaint"] == "Chest pain, fever"
    assert built.frames["Prescription"].head()["medicines"] == ["Drug A 5 mg PO 2x/day", "Drug B"]
    assert built.frames["UnitAdmission"].head()["service_given"] == "MED"
    icu = built.frames["ICUStay"].head()
    assert (icu.outtime, icu.first_careunit) == (t(4), "MICU")
    assert {(r.source, tuple(r.procedures)) for r in built.frames["Procedures"].collect()} == {
        ("ICU_EVENTS", ("Vent (Task) - Item with value 1.0h (Ref: 1.0 - 2.0)",)), ("ICD", ("Tube",)), ("ICD", ("Unknown",)),
    }
    assert built.frames["Discharge"].head()["disposition"] == "Home"


def test_build_twice_is_the_same(tables, built):
    again = build(tables)
    assert set(map(str, again.nodes().collect())) == set(map(str, built.nodes().collect()))
    assert set(map(str, again.edges().collect())) == set(map(str, built.edges().collect()))


def test_journey(spark, tables, built):
    subjects = tables["patients"].where("subject_id = 1")
    mine = journey.patient_nodes(built.nodes(), built.edges(), subjects)
    labels = {r.label for r in mine.collect()}
    assert "LabEvent" in labels and "Provider" not in labels
    timed = journey.with_gaps(journey.events(mine)).orderBy("ts", "label", "key").collect()
    assert timed[0].gap is None
    assert [r.ts for r in timed] == sorted(r.ts for r in timed)


def test_unify_keeps_first_node(built):
    firsts = nodes.first_of_each_key(built.nodes())
    assert firsts.groupBy("node_key").count().where("count > 1").count() == 0
