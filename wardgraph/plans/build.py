"""Building the event graph from the hospital tables.

``build`` takes the tables it is given and leaves out what it lacks. Every
node and edge row carries its patient, and keys are unique per label, so one
patient's graph never touches another's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgraph.functions import clinical, text
from wardgraph.functions.numbers import out_of_range
from wardgraph.functions.times import format_ts, period_string
from wardgraph.operators import bundles, diagnoses, flow, graph, intervals, lookups, nodes
from wardgraph.session import written
from wardgraph.sources import files, store

EDGE_COLUMNS = [*graph.EDGE_KEY, "subject_id", "props"]


@dataclass
class Graph:
    """Node frames by label, each with ``key`` and ``subject_id``, and edge frames."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    edge_frames: list[DataFrame] = field(default_factory=list)
    save: Callable[[DataFrame, str], DataFrame] = written

    def nodes(self) -> DataFrame:
        """All nodes in one table; see ``operators.nodes.unify``."""
        return nodes.unify(self.frames)

    def edges(self) -> DataFrame:
        """All edges, each once."""
        out = self.edge_frames[0]
        for frame in self.edge_frames[1:]:
            out = out.unionByName(frame)
        return out.dropDuplicates(graph.EDGE_KEY)

    def add(self, label: str, frame: DataFrame) -> None:
        known = self.frames.get(label)
        self.frames[label] = frame if known is None else known.unionByName(frame, allowMissingColumns=True)

    def link(self, rows: DataFrame, src_label, src_key, rel, dst_label, dst_key, props: Column | None = None) -> None:
        """Add edges; labels and the relation are names or columns, keys are columns."""

        def col(x) -> Column:
            return F.lit(x) if isinstance(x, str) else x

        if props is None:
            props = F.create_map().cast("map<string,string>")
        self.edge_frames.append(
            rows.select(
                col(src_label).alias("src_label"),
                src_key.cast("string").alias("src_key"),
                col(rel).alias("rel"),
                col(dst_label).alias("dst_label"),
                dst_key.cast("string").alias("dst_key"),
                F.col("subject_id").cast("bigint").alias("subject_id"),
                props.alias("props"),
            ).where(F.col("src_key").isNotNull() & F.col("dst_key").isNotNull())
        )


def at(key: Column, *more: Column) -> Column:
    """Key made of several parts."""
    return F.concat_ws("@", key, *more)


def _time(c: str) -> Column:
    return format_ts(F.col(c))


def build(tables: Mapping[str, DataFrame], save: Callable[[DataFrame, str], DataFrame] = written) -> Graph:
    """The graph of the given hospital tables.

    ``save`` stores what several frames are made of (merged stays, bundles,
    joined notes), so that no join of a fact table runs twice.
    """
    g = Graph(save=save)
    stays = _patients_and_flow(g, tables, save)
    if stays is not None:
        _bundles(g, tables, stays)
    _emergency(g, tables)
    _admission_facts(g, tables, stays)
    if "notes_flat" in tables:
        from wardgraph.plans.note_facts import add_note_facts

        add_note_facts(g, tables, stays)
    return g


def _patients_and_flow(g: Graph, t: Mapping[str, DataFrame], save) -> DataFrame | None:
    patients, admissions = t["patients"], t["admissions"]
    counts = flow.admission_counts(admissions)
    known = patients.join(counts, "subject_id", "left").withColumns(
        {"total_number_of_admissions": F.coalesce("total_number_of_admissions", F.lit(0)), "name": F.lit("Patient")}
    )
    if "diagnoses_icd" in t:
        known = known.join(_all_diagnoses(t), "subject_id", "left")
    g.add("Patient", known.withColumn("key", F.col("subject_id").cast("string")))

    numbered = flow.admission_sequence(admissions).withColumns(
        {
            "key": F.col("hadm_id").cast("string"),
            "name": F.lit("HospitalAdmission"),
            "period": period_string(F.col("admittime"), F.col("dischtime")),
        }
    )
    g.add("HospitalAdmission", numbered)
    if "transfers" not in t:
        return None

    transfers = t["transfers"]
    if "services" in t:
        transfers = flow.with_service(transfers, t["services"])
    merged = flow.continuous_stays(transfers)
    if "icustays" in t:
        merged = flow.relabel_icu(merged, t["icustays"])
    stays = save(merged.withColumn("key", F.col("event_id")), "stays")
    for label in ("UnitAdmission", "ICUStay", "Discharge"):
        g.add(label, stays.where(F.col("label") == label).drop("label"))

    edstays = t.get("edstays")
    if edstays is None:
        edstays = t["transfers"].where(F.lit(False)).withColumn("stay_id", F.col("transfer_id"))
    visits = save(_emergency_visits(transfers, edstays), "visits")
    g.add("EmergencyDepartment", visits)
    g.link(visits, "Patient", F.col("subject_id"), "VISITED_ED", "EmergencyDepartment", F.col("key"))

    steps = flow.flow_edges(flow.with_previous_stay(stays))
    g.link(steps, F.col("src_label"), F.col("src_key"), F.col("rel"), F.col("dst_label"), F.col("dst_key"))

    label_of = stays.select("event_id", F.col("label").alias("_kept"))
    first = flow.first_event(edstays, transfers).join(label_of, "event_id", "left")
    first = save(first.withColumn("label", F.coalesce(F.col("_kept"), F.col("label"))).drop("_kept"), "first_events")
    units = first.where(F.col("eventtype") != "ed")
    g.link(units, "Patient", F.col("subject_id"), "ADMITTED_TO_UNIT", F.col("label"), F.col("event_id"))
    opened = flow.admission_links(first, admissions)
    g.link(opened, F.col("label"), F.col("event_id"), F.col("rel"), "HospitalAdmission", F.col("hadm_id"))

    discharges = stays.where(F.col("label") == "Discharge")
    following = flow.next_ed_visit(discharges, visits.select("subject_id", "event_id", "intime"))
    g.link(
        following, "Discharge", F.col("discharge_id"), "LED_TO_ED_VISIT", "EmergencyDepartment", F.col("ed_event_id"),
        F.create_map(F.lit("gap"), F.col("gap")),
    )
    return stays


def _emergency_visits(transfers: DataFrame, edstays: DataFrame) -> DataFrame:
    """Emergency visits of both sources, numbered, one row each."""
    own = flow.ed_sequence(edstays).withColumn("event_id", flow.event_id(F.col("stay_id")))
    rest = flow.ed_sequence_continued(transfers, edstays).withColumn("event_id", flow.event_id(F.col("transfer_id")))
    cols = ["subject_id", "hadm_id", "event_id", "intime", "outtime", "ed_seq_num"]
    extra = [c for c in ("disposition", "arrival_transport") if c in own.columns]
    both = own.select(*cols, *extra).unionByName(rest.select(*cols), allowMissingColumns=True)
    return both.withColumns(
        {
            "key": F.col("event_id"),
            "name": F.lit("EmergencyDepartment"),
            "period": period_string(F.col("intime"), F.col("outtime")),
        }
    )


def save_graph(g: Graph, path: str, mode: str = "overwrite") -> None:
    """Write the graph: one table per label, and the edges in one folder per relation.

    ``append`` adds the nodes and edges that are not stored yet, by key, so a save
    that was broken off can be repeated. ``merge`` does so too, and gives stored
    nodes and edges their new properties; it reads only the buckets it changes.
    """
    if mode == "merge":
        for label, frame in g.frames.items():
            store.merge(frame, f"{path}/nodes/{label}", ["key"])
        store.merge(g.edges(), f"{path}/edges", graph.EDGE_KEY)
        return
    if mode == "append":
        for label, frame in g.frames.items():
            files.append_new(frame, f"{path}/nodes/{label}", ["key"])
        files.append_new(g.edges(), f"{path}/edges", graph.EDGE_KEY, partition_by=["rel"])
        return
    for label, frame in g.frames.items():
        frame.write.mode(mode).parquet(f"{path}/nodes/{label}")
    g.edges().write.mode(mode).partitionBy("rel").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, labels: Iterable[str]) -> Graph:
    """The graph as written by ``save_graph``."""

    def table(place: str) -> DataFrame:
        return store.read(spark, place) if store.exists(spark, place) else spark.read.parquet(place)

    g = Graph({label: table(f"{path}/nodes/{label}") for label in labels})
    g.edge_frames.append(table(f"{path}/edges").select(*EDGE_COLUMNS))
    return g


def stay_windows(g: Graph) -> DataFrame:
    """Whatever has a start and an end, of any label."""
    out = None
    for label in ("EmergencyDepartment", "UnitAdmission", "ICUStay", "Discharge"):
        if label in g.frames:
            one = g.frames[label].select(
                "subject_id", "hadm_id", "event_id", F.lit(label).alias("label"), "intime", "outtime"
            )
            out = one if out is None else out.unionByName(one)
    return out.where(F.col("intime").isNotNull() & F.col("outtime").isNotNull())


def _add_bundles(g: Graph, made: DataFrame, rel: str, batch: str, contained: str, label: str, key: Column) -> None:
    """Bundles with their batch: stay → batch → bundle."""
    keyed = g.save(made.withColumn("key", key), label)
    owners = keyed.select("event_id", "label", "subject_id").distinct().withColumn("key", F.col("event_id"))
    g.add(batch, owners.select("key", "event_id", "subject_id", F.lit(batch).alias("name")).distinct())
    g.link(owners, F.col("label"), F.col("event_id"), rel, batch, F.col("key"))
    g.add(label, keyed.drop("label").withColumn("name", F.lit(label)))
    g.link(keyed, batch, F.col("event_id"), contained, label, F.col("key"))


def _bundles(g: Graph, t: Mapping[str, DataFrame], stays: DataFrame) -> None:
    windows = stay_windows(g)
    if "prescriptions" in t:
        rows = t["prescriptions"]
        if "poe_id" in rows.columns:
            rows = bundles.keep_first(rows, "poe_id", ["starttime", "drug", "dose_val_rx", "route"])
        described = rows.withColumn(
            "_text",
            clinical.medicine(*[F.col(c) for c in ["drug", "dose_val_rx", "dose_unit_rx", "route", "doses_per_24_hrs"]]),
        )
        placed = intervals.assign(described, windows, "starttime", null_safe=True)
        made = bundles.bundle(
            placed, ["event_id", "label", "subject_id", "starttime"], F.col("_text"), [F.col("_text")], "medicines", "medicine_count"
        )
        _add_bundles(g, made, "ISSUED_PRESCRIPTIONS", "PrescriptionsBatch", "CONTAINED_PRESCRIPTION", "Prescription",
                     at(F.col("event_id"), _time("starttime")))
    labs_known = "labevents" in t
    if labs_known:
        described = lookups.with_items(t["labevents"], t["d_labitems"], ["label", "fluid", "category"])
        described = described.withColumns(
            {
                "_text": clinical.lab_result(
                    *[F.col(c) for c in ["label", "valuenum", "valueuom", "ref_range_lower", "ref_range_upper", "flag", "fluid", "category"]]
                ),
                "_bad": out_of_range(F.col("valuenum"), F.col("ref_range_lower"), F.col("ref_range_upper")),
            }
        ).drop("label")
        placed = intervals.assign(described, windows, "charttime")
        made = bundles.bundle(
            placed, ["event_id", "label", "subject_id", "hadm_id", "charttime"], F.col("_text"), [F.col("labevent_id")],
            "lab_results", "lab_count", flagged=(F.col("_bad"), "abnormal_results", "abnormal_count"),
        )
        _add_bundles(g, made, "INCLUDED_LAB_EVENTS", "LabEvents", "CONTAINED_LAB_EVENT", "LabEvent",
                     at(F.col("event_id"), _time("charttime")))
    if "microbiologyevents" in t:
        known = t["microbiologyevents"].where(F.col("micro_specimen_id").isNotNull()).withColumn(
            "_text",
            clinical.micro_result(
                *[F.col(c) for c in ["spec_type_desc", "test_name", "org_name", "ab_name", "dilution_value", "interpretation", "comments"]]
            ),
        )
        placed = intervals.assign(known, windows, "charttime", null_safe=True)
        made = bundles.bundle(
            placed, ["event_id", "label", "subject_id", "micro_specimen_id", "charttime"], F.col("_text"),
            [F.col("microevent_id")] if "microevent_id" in known.columns else [F.col("_text")], "micro_results", "micro_count",
        )
        _add_bundles(g, made, "INCLUDED_LAB_EVENTS", "LabEvents", "CONTAINED_MICROBIOLOGY_EVENT", "MicrobiologyEvent",
                     at(F.col("event_id"), F.col("micro_specimen_id").cast("string"), _time("charttime")))
        if labs_known:
            g.frames["LabEvents"] = g.frames["LabEvents"].dropDuplicates(["key"])
    if "chartevents" in t:
        described = lookups.with_items(
            t["chartevents"], t["d_items"], ["label", "unitname", "param_type", "lownormalvalue", "highnormalvalue"]
        ).withColumn(
            "_text",
            clinical.chart_measurement(
                *[F.col(c) for c in ["label", "value", "valuenum", "valueuom", "unitname", "param_type", "lownormalvalue", "highnormalvalue"]]
            ),
        ).drop("label")
        placed = intervals.assign(described, windows.where(F.col("label") == "ICUStay"), "charttime")
        made = bundles.bundle(
            placed, ["event_id", "label", "subject_id", "hadm_id", "charttime"], F.col("_text"),
            [F.col("itemid"), F.col("_text")], "chart_measurements", "measurement_count",
        )
        _add_bundles(g, made, "RECORDED_CHART_EVENTS", "ChartEventBatch", "CONTAINED_CHART_EVENT", "ChartEvent",
                     at(F.col("event_id"), _time("charttime")))
    _procedures(g, t, stays)


def _procedures(g: Graph, t: Mapping[str, DataFrame], stays: DataFrame) -> None:
    cols = ["event_id", "label", "subject_id", "hadm_id", "time", "source", "text"]
    parts = []
    if "procedureevents" in t and "icustays" in t:
        rows = t["procedureevents"].drop("subject_id", "hadm_id")
        icu = lookups.on_icu_stay(lookups.tasks(rows), t["icustays"]).join(
            stays.where(F.col("label") == "ICUStay").select("event_id"), "event_id", "left_semi"
        )
        icu = lookups.with_items(icu, t["d_items"], ["label", "lownormalvalue", "highnormalvalue"])
        described = icu.withColumn(
            "text",
            clinical.icu_procedure(
                *[F.col(c) for c in ["ordercategoryname", "ordercategorydescription", "label", "value", "valueuom", "lownormalvalue", "highnormalvalue"]]
            ),
        )
        parts.append(
            described.withColumns({"time": F.col("starttime"), "source": F.lit("ICU_EVENTS"), "label": F.lit("ICUStay")}).select(*cols)
        )
    if "procedures_icd" in t:
        coded = t["procedures_icd"]
        titled = lookups.with_titles(coded, t["d_icd_procedures"]).withColumn(
            "text", clinical.or_default(F.col("long_title"), clinical.UNKNOWN)
        )
        units = stays.select("subject_id", "hadm_id", "event_id", "label", "intime", "outtime").where(
            F.col("label").isin("UnitAdmission", "ICUStay")
        )
        in_units = intervals.assign_dates(titled, units, "chartdate")
        whole = t["admissions"].select(
            "subject_id", "hadm_id", F.col("hadm_id").cast("string").alias("event_id"), F.lit("HospitalAdmission").alias("label"),
            F.col("admittime").alias("intime"), F.col("dischtime").alias("outtime"),
        )
        left_over = intervals.assign_dates(intervals.not_attached(titled, in_units, "chartdate"), whole, "chartdate")
        dated = in_units.select(*left_over.columns).unionByName(left_over)
        parts.append(
            dated.withColumns({"time": F.col("chartdate").cast("timestamp_ntz"), "source": F.lit("ICD")}).select(*cols)
        )
    if not parts:
        return
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    made = bundles.bundle(
        rows, ["event_id", "label", "subject_id", "hadm_id", "time", "source"], F.col("text"), [F.col("text")],
        "procedures", "procedure_count",
    )
    _add_bundles(g, made, "INCLUDED_PROCEDURES", "ProceduresBatch", "CONTAINED_PROCEDURE", "Procedures",
                 at(F.col("event_id"), _time("time"), F.col("source")))


def _emergency(g: Graph, t: Mapping[str, DataFrame]) -> None:
    if "edstays" not in t:
        return
    edstays = t["edstays"]
    key = F.col("stay_id").cast("string")

    def on_stay(rows: DataFrame) -> DataFrame:
        return lookups.on_ed_stay(rows.drop("subject_id"), edstays)

    def with_patient(made: DataFrame) -> DataFrame:
        return made.join(edstays.select("stay_id", "subject_id"), "stay_id").withColumn("key", key)

    if "medrecon" in t:
        line = clinical.previous_medicine(F.col("name"), F.col("etcdescription"))
        made = with_patient(bundles.list_by_stay(on_stay(t["medrecon"]), line, [F.col("charttime"), F.col("name")], "charttime"))
        g.add("PreviousPrescriptionMeds", made.withColumn("name", F.lit("PreviousPrescriptionMeds")))
        g.link(made, "EmergencyDepartment", key, "RECORDED_PREVIOUS_MEDICATIONS", "PreviousPrescriptionMeds", key)
    if "pyxis" in t:
        made = with_patient(bundles.list_by_stay(on_stay(t["pyxis"]), F.col("name"), [F.col("charttime"), F.col("name")], "charttime"))
        g.add("AdministeredMeds", made.withColumn("name", F.lit("AdministeredMeds")))
        g.link(made, "EmergencyDepartment", key, "ADMINISTERED_MEDICATIONS", "AdministeredMeds", key)
    if "triage" in t:
        made = on_stay(t["triage"]).withColumns({"key": key, "name": F.lit("InitialAssessment")})
        if "notes_flat" in t:
            made = _with_note_complaint(made, edstays, t["notes_flat"])
        g.add("InitialAssessment", made)
        g.link(made, "EmergencyDepartment", key, "INCLUDED_TRIAGE_ASSESSMENT", "InitialAssessment", key)
    if "ed_diagnosis" in t:
        order = [c for c in ("seq_num", "icd_title") if c in t["ed_diagnosis"].columns]
        made = diagnoses.emergency_list(on_stay(t["ed_diagnosis"]), order).withColumns(
            {"key": F.concat(key, F.lit("@ed")), "event_id": key, "ed_diagnosis": F.lit(True), "name": F.lit("Diagnosis")}
        )
        g.add("Diagnosis", made.drop("stay_id"))
        g.link(made, "EmergencyDepartment", key, "RECORDED_DIAGNOSES", "Diagnosis", F.col("key"))


def _with_note_complaint(triage: DataFrame, edstays: DataFrame, notes: DataFrame) -> DataFrame:
    """Triage rows with the complaint of the admission's note merged in."""
    told = (
        notes.where(F.col("hadm_id").isNotNull() & F.col("chief_complaint").isNotNull())
        .groupBy("subject_id", "hadm_id")
        .agg(F.min_by("chief_complaint", "note_id").alias("_told"))
        .join(edstays.where(F.col("hadm_id").isNotNull()).select("stay_id", "hadm_id", "subject_id"), ["subject_id", "hadm_id"])
        .select("stay_id", "_told")
    )
    merged = text.merge_complaint(F.col("chiefcomplaint"), F.col("_told"))
    return triage.join(told, "stay_id", "left").withColumn("chiefcomplaint", merged).drop("_told")


def diagnosis_items(t: Mapping[str, DataFrame], include_ed: bool = True) -> DataFrame:
    """Every mention of a diagnosis: subject_id, title, and its place in time of record."""
    coded = lookups.with_titles(t["diagnoses_icd"], t["d_icd_diagnoses"])
    items = coded.select(
        "subject_id",
        clinical.or_default(F.col("long_title"), clinical.UNKNOWN).alias("title"),
        F.lit(0).alias("part"),
        F.col("hadm_id").alias("place"),
        F.col("seq_num").cast("bigint").alias("rank"),
    )
    if include_ed and "ed_diagnosis" in t:
        rows = t["ed_diagnosis"]
        rank = F.col("seq_num").cast("bigint") if "seq_num" in rows.columns else F.lit(0).cast("bigint")
        items = items.unionByName(
            rows.select("subject_id", F.col("icd_title").alias("title"), F.lit(1).alias("part"), F.col("stay_id").alias("place"), rank.alias("rank"))
        )
    if "notes_flat" in t:
        notes = t["notes_flat"]
        for part, c in ((2, "primary_diagnoses"), (3, "secondary_diagnoses")):
            listed = notes.select("subject_id", "hadm_id", F.posexplode(text.split_list(F.col(c))).alias("rank", "title"))
            items = items.unionByName(
                listed.select("subject_id", "title", F.lit(part).alias("part"), F.col("hadm_id").alias("place"), F.col("rank").cast("bigint"))
            )
    return items


def _all_diagnoses(t: Mapping[str, DataFrame]) -> DataFrame:
    return diagnoses.patient_union(diagnosis_items(t), ["part", "place", "rank"])


def _admission_facts(g: Graph, t: Mapping[str, DataFrame], stays: DataFrame | None) -> None:
    admissions = t["admissions"]
    if "admit_provider_id" in admissions.columns:
        named = admissions.withColumn("provider_id", F.trim("admit_provider_id")).where(F.col("provider_id") != "")
        key = at(F.col("provider_id"), F.col("subject_id").cast("string"))
        keyed = named.withColumn("key", key)
        g.add(
            "Provider",
            keyed.select("key", "provider_id", "subject_id", F.lit("Provider").alias("name")).dropDuplicates(["key"]),
        )
        g.link(keyed, "Provider", F.col("key"), "MANAGED_ADMISSION", "HospitalAdmission", F.col("hadm_id"))
    if "drgcodes" in t:
        kind, code = F.col("drg_type"), F.col("drg_code")
        coded = lookups.on_admission(t["drgcodes"], admissions).withColumns(
            {"key": clinical.drg_key(F.col("hadm_id"), kind, code), "name": clinical.drg_name(kind)}
        )
        g.add("DRG", coded.dropDuplicates(["key"]))
        g.link(coded, "HospitalAdmission", F.col("hadm_id"), "WAS_ASSIGNED_DRG_CODE", "DRG", F.col("key"))
    if "diagnoses_icd" in t and stays is not None:
        listed = diagnoses.admission_list(lookups.with_titles(t["diagnoses_icd"], t["d_icd_diagnoses"]))
        ends = stays.where(F.col("label") == "Discharge").select("subject_id", "hadm_id", "event_id")
        made = listed.join(ends, ["subject_id", "hadm_id"]).withColumns({"key": F.col("event_id"), "name": F.lit("Diagnosis")})
        g.add("Diagnosis", made)
        g.link(made, "Discharge", F.col("event_id"), "RECORDED_DIAGNOSES", "Diagnosis", F.col("key"))
