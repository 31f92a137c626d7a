"""Whole jobs: cohort cut, pipeline, notes, streams."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardgraph.functions import notes as N
from wardgraph.operators import embedding
from wardgraph.plans import build, cohort, notes, pipeline
from wardgraph.sources import files, schemas, store
from wardgraph.streaming import arrivals

NOTE = """Name:  ___                     Unit No:   ___

Sex:   F

Service: MEDICINE

Allergies:
Walnuts / Latex
___

Attending: ___.

Chief Complaint:
Swollen left knee

Major Surgical or Invasive Procedure:
___ Arthroscopy

History of Present Illness:
___ gout presents with stiffness.
In the ED, initial vitals were 99.1 82 121/77 15 98%RA
Labs were significant for Na 139 K 4.1 lactate 1.2 INR 1.1. ALT 31 AST 28 AP 77. no leukocytosis.

Past Medical History:
1. COPD
2. A cyst was found, which was drained
earlier.
- Cholelithiasis

Social History:
___
Family History:
Last drug use was in school. Uncle with gout.

Physical Exam:
Vitals - T 98, BP 118/72, HR 77, RR 14, O2 95RA, Glucose 101.
GENERAL: NAD
NECK: supple
 no LAD
EXTREMITIES: warm
PULSES: 2+

Pertinent Results:
ADMISSION LABS:
___ 08:15PM   GLUCOSE-96* UREA N-14* CREAT-0.8*
___ 08:15PM   WBC-7.2# HGB-12.9
DISCHARGE LABS:
___ 06:00AM WBC-6.8
IMAGING:
CXR: Clear lungs.

Brief Hospital Course:
___ Did well.

Medications on Admission:
The Preadmission Medication list is accurate.
1. Allopurinol 100 mg PO DAILY

Discharge Medications:
1. Allopurinol 100 mg PO DAILY
RX *allopurinol 100 mg 1 (One) tablet(s) daily Disp #*14 Tablet Refills:*1
2. Ibuprofen 200 mg

Discharge Disposition:
Home

Discharge Diagnosis:
Knee effusion

Discharge Condition:
Mental Status: Clear.

Discharge Instructions:
You will follow up with your doctor soon. Bye.

Followup Instructions:
___
"""


def frame(spark, *texts):
    rows = [(f"n{i}", 1, 10, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "note_id string, subject_id bigint, hadm_id bigint, text string")


def test_a_note(spark):
    docs = notes.documents(notes.read_notes(frame(spark, NOTE, "nothing")))
    first, second = [json.loads(r.json_data) for r in docs.orderBy("note_id").collect()]
    assert first["Administrative Information"]["Allergies"] == ["Walnuts / Latex"]
    assert first["Administrative Information"]["Attending"] is None
    said = first["Clinical Summary"]
    assert said["Past Medical History"] == ["COPD", "A cyst was found, which was drained earlier.", "Cholelithiasis"]
    assert said["Social History"] == "Last drug use was in school."
    assert said["Family History"] == "Uncle with gout."
    hpi = first["History of Present Illness"]
    assert hpi["Summary"] == "gout presents with stiffness."
    assert hpi["ED Findings"]["Vitals"]["SpO2"] == "98%RA"
    assert hpi["ED Labs"]["Alkaline Phosphatase"] == "77" and hpi["ED Labs"]["Leukocytosis"] == "no leukocytosis"
    exam = first["Physical Examination"]["Admission Exam"]
    assert exam["Neck"] == "supple no LAD" and exam["Extremities"] == "warm PULSES: 2+"
    assert exam["Vitals"]["Glucose"] == "101"
    assert first["Pertinent Results"]["Discharge Labs"] == {"WBC": "6.8"}
    assert first["Medications"]["On Discharge"] == [
        "Allopurinol 100 mg PO DAILY RX *allopurinol 100 mg 1 (One) tablet(s) daily Disp #*14 Tablet Refills:*1", "Ibuprofen 200 mg",
    ]
    left = first["Discharge Information"]
    assert left["Secondary Diagnoses"] == ["COPD", "Cholelithiasis"]
    assert left["Follow-up"].startswith("You will follow up")
    assert list(second) == notes.PARTS and second["Medications"] == {"On Admission": [], "On Discharge": []}
    flat = notes.flatten(notes.parts_of(docs)).orderBy("note_id").head()
    assert flat.admission_labs == "WBC: 7.2#, Hemoglobin: 12.9, Creatinine: 0.8*, Glucose: 96*, BUN: 14*"
    assert flat.imaging_studies == "CXR" and flat.imaging_count == 1
    assert len(flat) == 3 + 32


@pytest.mark.parametrize(
    "line, want",
    [
        ("99.1 82 121/77 15 98%RA", ("99.1", "82", "121/77", "15", "98%RA")),
        ("VS: 98.2 PO 117 / 74 66 13 99 ra", ("98.2", "66", "117/74", "13", "99%RA")),
        ("HR 80-95", (None, "80-95", None, None, None)),
        ("T 98, BP 118/72, HR 77, RR ___, O2 95RA", ("98", "77", "118/72", None, "95%RA")),
    ],
)
def test_vitals(spark, line, want):
    got = spark.createDataFrame([(line,)], "x string").select(N.vitals(F.col("x")).alias("v")).head()["v"]
    assert tuple(got[f] for f in N.R.VITAL_FIELDS) == want


def test_lab_values_behind_long_prose(spark):
    """A text without values costs its length, not its square."""
    text = "lorem ipsum " * 20_000 + ". WBC-7.2#HGB-12.9 GLUCOSE-96*"
    got = frame(spark, text).select(N.lab_values(F.col("text")).alias("v")).head()["v"]
    assert got["WBC"] == "7.2#" and {"12.9", "96*"} <= set(got.values())


def test_headings(spark):
    rules = {"a": ("Chief Complaint:", "History")}
    texts = ["CHIEF COMPLAINT:\nx\nHISTORY", "Chief Complaint\ny", "chief complaint: z", "none"]
    got = N.with_sections(frame(spark, *texts), "text", rules).orderBy("note_id").collect()
    assert [r.s_a for r in got] == ["x", "y", "z", ""]


def test_headings_are_found_in_a_folded_text(spark):
    """The same tails as a search for any case, in texts of other scripts too, without such a search over the note."""
    odd = ["", "İ", "K", "ÄȺ", "\U0001f600", "Σ ", "\n"]
    bodies = [
        "aLLergies: x", "Allergies y", "Discharge: \n PHYSICAL examination z", "discharge soon: physical examination", "DISCHARGE PE",
        "primary diagnosis q DISCHARGE Diagnosis: r", "Followup\nFollow-up Instructions", "followup İnstructions:", "K: physical exam:", None,
    ]
    texts = [None if b is None else a + b + c + b.upper() for b in bodies for a in odd for c in odd]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    c, starts = F.col("text"), [s for s, _ in N.R.SECTIONS.values()]

    def any_case(start):
        return F.coalesce(*[N.find(c, f"(?:{s}){N.REST}", "(?im)", 0) for s in N._heading_forms(start)])

    pairs = [x.alias(f"{k}{i}") for i, s in enumerate(starts) for k, x in (("new", N.from_heading(c, s)), ("old", any_case(s)))]
    rows = df.select(*pairs).collect()
    assert all(r[f"new{i}"] == r[f"old{i}"] for r in rows for i in range(len(starts)))
    assert sum(r["old0"] is not None for r in rows) > 0
    plan = df.select(*[N.from_heading(c, s) for s in starts])._jdf.queryExecution().optimizedPlan().toString()
    assert "(?im)" not in plan


def test_chunks_equal_a_plain_loop(spark):
    chunker = embedding.character_chunker(40, 10)
    texts = ["word. " * 30, "no marks here at all " * 9, "a | b | " * 20, "short", ""]
    got = [r.c for r in frame(spark, *texts).orderBy("note_id").select(chunker(F.col("text")).alias("c")).collect()]

    def plain(t):
        out, start = [], 0
        while True:
            end = start + 40
            if end >= len(t):
                return [*out, t[start:]]
            stop = max(t.rfind(".", start, end), t.rfind("|", start, end))
            end = stop + 1 if stop > start else end
            out.append(t[start:end])
            start = max(end - 10, start + 1)

    assert got == [plain(t) for t in texts]


def at(day, hour=0):
    return datetime(2150, 1, day, hour)


@pytest.fixture(scope="module")
def delivered(spark, tmp_path_factory):
    """Hospital CSV files of three patients, one of them outside the cohort."""
    root = str(tmp_path_factory.mktemp("delivered"))

    def put(module, name, schema, rows):
        df = spark.createDataFrame(rows, schema)
        files.csv_sink(df, f"{root}/{module}/{name}.csv")

    put("hosp", "patients", "subject_id bigint, gender string, anchor_age int", [(1, "F", 60), (2, "M", 50), (3, "M", 40)])
    put("hosp", "admissions", "subject_id bigint, hadm_id bigint, admittime string, dischtime string",
        [(i, 10 * i, "2150-01-01 09:00:00", "2150-01-04 00:00:00") for i in (1, 2, 3)])
    put("hosp", "transfers", "subject_id bigint, hadm_id bigint, transfer_id bigint, eventtype string, careunit string, intime string, outtime string",
        [x for i in (1, 2, 3) for x in [
            (i, 10 * i, 100 * i, "admit", "Med", "2150-01-01 10:00:00", "2150-01-04 00:00:00"),
            (i, 10 * i, 100 * i + 1, "discharge", "", "2150-01-04 00:00:00", ""),
        ]])
    put("hosp", "diagnoses_icd", "subject_id bigint, hadm_id bigint, seq_num int, icd_code string, icd_version string", [(1, 10, 1, "0042", "9")])
    put("hosp", "d_icd_diagnoses", "icd_code string, icd_version string, long_title string", [("0042", "9", "Sepsis, severe")])
    put("hosp", "omr", "subject_id bigint, result string", [(1, "a"), (3, "b")])
    put("note", "discharge", "note_id string, subject_id bigint, hadm_id bigint, note_type string, note_seq int, charttime string, storetime string, text string",
        [("n1", 1, 10, "DS", 1, "2150-01-04 00:00:00", "2150-01-04 00:00:00", NOTE)])
    return root


def test_cut_and_pipeline(spark, delivered, tmp_path):
    cut, target = str(tmp_path / "cut"), str(tmp_path / "out")
    cohort_list = spark.createDataFrame([("1",), ("2",), (None,)], "subject_id string")
    done = cohort.cut(spark, delivered, cut, cohort_list)
    assert set(done) == {
        "hosp/patients", "hosp/admissions", "hosp/transfers", "hosp/diagnoses_icd", "hosp/d_icd_diagnoses", "hosp/omr", "note/discharge",
    }
    assert spark.read.parquet(f"{cut}/hosp/omr").count() == 1
    assert spark.read.parquet(f"{cut}/hosp/d_icd_diagnoses").head()["icd_code"] == "0042"
    assert spark.read.parquet(f"{cut}/note/discharge").head()["text"].count("\n") == NOTE.count("\n")

    assert pipeline.run(spark, cut, target) == {"patients": 2}
    vectors = spark.read.parquet(f"{target}/vectors/text")
    assert {r.subject_id for r in vectors.collect()} == {1, 2}
    edges = store.read(spark, f"{target}/graph/edges").count()
    assert spark.read.parquet(f"{target}/vectors/diagnoses").head()["all_diagnoses"][0] == "Sepsis, severe"
    # Nothing new: nothing is added.
    assert pipeline.run(spark, cut, target) == {"patients": 0}
    # One patient more: only this one is built.
    more = str(tmp_path / "more")
    cohort.cut(spark, delivered, more, spark.createDataFrame([("1",), ("2",), ("3",)], "subject_id string"))
    assert pipeline.run(spark, more, target) == {"patients": 1}
    assert spark.read.parquet(f"{target}/vectors/text").count() == 3
    assert store.read(spark, f"{target}/graph/edges").count() > edges


def test_a_broken_run_is_taken_up(spark, delivered, tmp_path, monkeypatch):
    cut, broken, whole = (str(tmp_path / p) for p in ("cut", "broken", "whole"))
    cohort.cut(spark, delivered, cut, spark.createDataFrame([("1",), ("2",)], "subject_id string"))
    save = pipeline.save_graph

    def torn(made, path, mode):
        part = dict(list(made.frames.items())[:2])
        save(build.Graph(part, made.edge_frames), path, mode)
        raise RuntimeError("torn")

    def failing(text):
        return F.when(text.isNotNull(), F.raise_error(F.lit("no model")).cast("array<float>"))

    monkeypatch.setattr(pipeline, "save_graph", torn)
    with pytest.raises(RuntimeError, match="torn"):
        pipeline.run(spark, cut, broken)
    monkeypatch.setattr(pipeline, "save_graph", save)
    with pytest.raises(Exception, match="no model"):
        pipeline.run(spark, cut, broken, failing)
    ends = {(r.script_name, r.status) for r in pipeline.read_log(spark, broken).collect()}
    assert ends == {("graph", "failed"), ("graph", "success"), ("text_embeddings", "failed")}
    assert pipeline.run(spark, cut, broken) == {"patients": 2}
    assert pipeline.run(spark, cut, broken) == {"patients": 0}

    pipeline.run(spark, cut, whole)
    tables = ["graph/edges", "vectors/text", "vectors/diagnoses", "notes/documents", "notes/flat"]
    tables += [f"graph/nodes/{p.name}" for p in (tmp_path / "whole/graph/nodes").iterdir()]
    for table in tables:
        load = store.read if table.startswith("graph/") else lambda s, path: s.read.parquet(path)
        one, other = (sorted(map(str, load(spark, f"{t}/{table}").collect())) for t in (broken, whole))
        assert one == other, table


def test_arriving_notes(spark, tmp_path):
    folder, out, mark = (str(tmp_path / p) for p in ("in", "out", "mark"))
    row = ("n1", 1, 10, "DS", 1, at(1), at(1), NOTE)
    for rows in ([row], [row, ("n2", 1, 10, "DS", 2, at(2), at(2), "nothing")]):
        files.append(spark.createDataFrame(rows, schemas.NOTE["discharge"]), folder)
        arrivals.document_stream(arrivals.read_arriving_notes(spark, folder), out, mark).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r.note_id for r in got.collect()) == ["n1", "n2"]


def test_first_orders_in_a_stream(spark, tmp_path):
    folder = str(tmp_path / "rx")
    schema = "poe_id string, starttime timestamp, drug string"
    rows = [("x", at(1), "a"), ("x", at(1, 1), "a"), (None, at(1), "b"), (None, at(1), "b")]
    files.append(spark.createDataFrame(rows, schema), folder)
    stream = arrivals.first_orders(spark.readStream.schema(schema).parquet(folder))
    q = stream.writeStream.format("memory").queryName("rx_once").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "mark")).start()
    q.awaitTermination()
    assert spark.table("rx_once").count() == 3


def test_cut_reads_notes_whole(spark, delivered, tmp_path):
    cut = str(tmp_path / "cut")
    done = cohort.cut(spark, delivered, cut, spark.createDataFrame([("1",), ("2",), (None,)], "subject_id string"))
    assert "note/discharge" in done
    assert spark.read.parquet(f"{cut}/note/discharge").head()["text"].count("\n") == NOTE.count("\n")


def test_only_the_wanted_csv_tables_are_delivered(spark, tmp_path):
    """A query that reads one table does not make the others; each is written once."""
    from wardgraph.suite import tables
    from wardgraph.suite.views import Views

    rows = [(1, 3, "A", -1.0), (2, 4, "B", 1.0)]
    spark.createDataFrame(rows, "c_custkey bigint, c_nationkey bigint, c_mktsegment string, c_acctbal double").write.parquet(
        str(tmp_path / "customer.parquet")
    )
    v = Views(spark, str(tmp_path))
    folder = tables.hospital_csv(v, "hosp/omr")
    assert [p.name for p in Path(folder, "hosp").iterdir()] == ["omr.csv"]
    for _ in range(2):
        assert tables.hospital_csv(v, "hosp/patients", "hosp/omr") == folder
    for name in ("omr", "patients"):
        assert files.csv_scan(spark, f"{folder}/hosp/{name}.csv", "subject_id bigint").count() == 2
