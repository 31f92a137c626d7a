"""The graph of the flow tables: build, scans, walks, rules and journeys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.functions.times import format_ts
from wardgraph.operators import graph, journey, nodes, quality
from wardgraph.plans.build import Graph, build
from wardgraph.session import shared_dir
from wardgraph.sources import files, store
from wardgraph.suite.flow import FIRST_SQL
from wardgraph.suite.registry import query
from wardgraph.suite.sql_views import VIEWS, gap, ts
from wardgraph.suite.views import Views

# --- the graph in Spark ---------------------------------------------------------


def graph_admissions(v: Views) -> DataFrame:
    return v.flow_admissions.withColumn(
        "admit_provider_id", F.concat(F.lit(" P"), (F.col("hadm_id") % 7).cast("string"))
    )


def drgcodes(v: Views) -> DataFrame:
    return v.flow_admissions.select(
        "subject_id", "hadm_id",
        F.when(F.col("hadm_id") % 2 == 0, "HCFA").otherwise("APR").alias("drg_type"),
        (F.col("hadm_id") % 13).cast("string").alias("drg_code"),
        F.lit("described").alias("description"),
        F.lit(None).cast("double").alias("drg_severity"),
        F.lit(None).cast("double").alias("drg_mortality"),
    )


_graphs: dict[tuple[str, str], Graph] = {}


def built(v: Views) -> Graph:
    """The graph of the tables, built once in a session."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _graphs:
        _graphs[key] = _build(v)
    return _graphs[key]


def _build(v: Views) -> Graph:
    return build(
        {
            "patients": v.patients,
            "admissions": graph_admissions(v),
            "transfers": v.transfers,
            "services": v.services,
            "edstays": v.edstays,
            "icustays": v.icustays,
            "labevents": v.labevents,
            "d_labitems": v.d_items,
            "drgcodes": drgcodes(v),
        }
    )


def graph_nodes(v: Views) -> DataFrame:
    return v.once("graph_nodes", lambda: built(v).nodes())


def graph_edges(v: Views) -> DataFrame:
    return v.once("graph_edges", lambda: built(v).edges())


# --- the same in SQL ------------------------------------------------------------

VIEWS["g_stays"] = """
    SELECT s.* REPLACE (CASE WHEN i.stay_id IS NOT NULL AND s.label = 'UnitAdmission' THEN 'ICUStay' ELSE s.label END AS label)
    FROM stays s LEFT JOIN icustays i ON s.event_id = CAST(i.stay_id AS VARCHAR)"""
VIEWS["g_windows"] = """
    SELECT subject_id, hadm_id, event_id, label, intime, outtime FROM g_stays WHERE label <> 'EmergencyDepartment'
    UNION ALL SELECT subject_id, hadm_id, CAST(transfer_id AS VARCHAR), 'EmergencyDepartment', intime, outtime
    FROM transfers WHERE eventtype = 'ed'"""
VIEWS["g_labs"] = """
    SELECT s.event_id, s.label, l.subject_id, l.charttime, l.labevent_id FROM labevents l JOIN g_windows s
    ON l.subject_id = s.subject_id AND l.hadm_id = s.hadm_id AND l.charttime BETWEEN s.intime AND s.outtime"""
VIEWS["g_firsts"] = "WITH " + FIRST_SQL + " SELECT * FROM firsts"
VIEWS["g_edges"] = f"""
    SELECT 'Patient' AS src_label, CAST(subject_id AS VARCHAR) AS src_key, 'VISITED_ED' AS rel,
           'EmergencyDepartment' AS dst_label, CAST(transfer_id AS VARCHAR) AS dst_key, subject_id
    FROM transfers WHERE eventtype = 'ed'
    UNION ALL
    SELECT p_label, p_id, CASE eventtype WHEN 'discharge' THEN 'LED_TO_DISCHARGE' ELSE 'LED_TO_UNIT_ADMISSION' END,
           label, event_id, subject_id
    FROM (SELECT *, lag(event_id) OVER w AS p_id, lag(label) OVER w AS p_label FROM g_stays
          WINDOW w AS (PARTITION BY subject_id, hadm_id ORDER BY intime, event_id::BIGINT))
    WHERE p_id IS NOT NULL AND eventtype <> 'ed'
    UNION ALL
    SELECT 'Patient', CAST(f.subject_id AS VARCHAR), 'ADMITTED_TO_UNIT', coalesce(s.label, 'UnitAdmission'), CAST(f.id AS VARCHAR), f.subject_id
    FROM g_firsts f LEFT JOIN g_stays s ON s.event_id = CAST(f.id AS VARCHAR) WHERE f.eventtype <> 'ed'
    UNION ALL
    SELECT CASE f.eventtype WHEN 'ed' THEN 'EmergencyDepartment' ELSE coalesce(s.label, 'UnitAdmission') END, CAST(f.id AS VARCHAR),
           CASE WHEN f.eventtype <> 'ed' THEN 'LED_TO_ADMISSION'
                WHEN a.admittime BETWEEN f.intime AND f.outtime THEN 'LED_TO_ADMISSION_DURING_STAY'
                WHEN a.admittime > f.outtime THEN 'LED_TO_ADMISSION_AFTER_DISCHARGE' ELSE 'LED_TO_ADMISSION' END,
           'HospitalAdmission', CAST(f.hadm_id AS VARCHAR), f.subject_id
    FROM g_firsts f JOIN flow_admissions a ON f.subject_id = a.subject_id AND f.hadm_id = a.hadm_id
         LEFT JOIN g_stays s ON s.event_id = CAST(f.id AS VARCHAR)
    WHERE a.admittime IS NOT NULL
    UNION ALL
    SELECT 'Discharge', d.event_id, 'LED_TO_ED_VISIT', 'EmergencyDepartment', CAST(e.transfer_id AS VARCHAR), d.subject_id
    FROM g_stays d ASOF JOIN (SELECT * FROM transfers WHERE eventtype = 'ed') e
         ON d.subject_id = e.subject_id AND d.intime < e.intime WHERE d.label = 'Discharge'
    UNION ALL
    SELECT DISTINCT label, event_id, 'INCLUDED_LAB_EVENTS', 'LabEvents', event_id, subject_id FROM g_labs
    UNION ALL
    SELECT DISTINCT 'LabEvents', event_id, 'CONTAINED_LAB_EVENT', 'LabEvent', event_id || '@' || {ts('charttime')}, subject_id FROM g_labs
    UNION ALL
    SELECT 'Provider', 'P' || (hadm_id % 7) || '@' || subject_id, 'MANAGED_ADMISSION', 'HospitalAdmission', CAST(hadm_id AS VARCHAR), subject_id
    FROM flow_admissions
    UNION ALL
    SELECT 'HospitalAdmission', CAST(hadm_id AS VARCHAR), 'WAS_ASSIGNED_DRG_CODE', 'DRG',
           hadm_id || '_' || CASE WHEN hadm_id % 2 = 0 THEN 'HCFA' ELSE 'APR' END || '_' || (hadm_id % 13), subject_id
    FROM flow_admissions"""
VIEWS["g_nodes"] = f"""
    SELECT 'Patient' AS label, CAST(subject_id AS VARCHAR) AS key, subject_id, 'Patient' AS name, NULL::TIMESTAMP AS ts FROM patients
    UNION ALL SELECT 'HospitalAdmission', CAST(hadm_id AS VARCHAR), subject_id, 'HospitalAdmission', coalesce(admittime, dischtime) FROM flow_admissions
    UNION ALL SELECT label, event_id, subject_id, CASE label WHEN 'Discharge' THEN 'Discharge' ELSE careunit END,
                     CASE label WHEN 'Discharge' THEN coalesce(outtime, intime) ELSE intime END
              FROM g_stays WHERE label <> 'EmergencyDepartment'
    UNION ALL SELECT 'EmergencyDepartment', CAST(transfer_id AS VARCHAR), subject_id, 'EmergencyDepartment', intime FROM transfers WHERE eventtype = 'ed'
    UNION ALL SELECT DISTINCT 'LabEvents', event_id, subject_id, 'LabEvents', NULL::TIMESTAMP FROM g_labs
    UNION ALL SELECT DISTINCT 'LabEvent', event_id || '@' || {ts('charttime')}, subject_id, 'LabEvent', charttime FROM g_labs
    UNION ALL SELECT DISTINCT 'Provider', 'P' || (hadm_id % 7) || '@' || subject_id, subject_id, 'Provider', NULL::TIMESTAMP FROM flow_admissions
    UNION ALL SELECT 'DRG', hadm_id || '_' || CASE WHEN hadm_id % 2 = 0 THEN 'HCFA' ELSE 'APR' END || '_' || (hadm_id % 13),
                     subject_id, CASE WHEN hadm_id % 2 = 0 THEN 'HCFA_DRG' ELSE 'APR_DRG' END, NULL::TIMESTAMP FROM flow_admissions"""
VIEWS["g_links"] = """
    SELECT DISTINCT src_label || '|' || src_key AS src, dst_label || '|' || dst_key AS dst FROM g_edges"""
VIEWS["g_roots"] = "SELECT 'Patient|' || subject_id AS root FROM patients"

REACH = """WITH RECURSIVE reach AS (SELECT root, root AS node FROM g_roots
        UNION SELECT r.root, l.dst FROM reach r JOIN g_links l ON r.node = l.src)"""


def _text(c: str):
    return format_ts(F.col(c)).alias(c)


# --- scans and sinks -------------------------------------------------------------


@query("s8_graph_node_sink", f"SELECT label, key, subject_id, name, {ts('ts')} AS ts FROM g_nodes")
def s8(v: Views) -> DataFrame:
    return graph_nodes(v).select("label", "key", "subject_id", "name", _text("ts"))


@query("s9_graph_edge_sink", "SELECT DISTINCT src_label, src_key, rel, dst_label, dst_key, subject_id FROM g_edges")
def s9(v: Views) -> DataFrame:
    kept = graph.edges_between(graph_edges(v), graph_nodes(v), graph_nodes(v))
    return kept.select("src_label", "src_key", "rel", "dst_label", "dst_key", "subject_id")


@query(
    "s8_graph_node_merge",
    """WITH stored AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey AS subject_id, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0),
       given AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey AS subject_id, lower(c_mktsegment) AS segment, c_nationkey AS nation FROM customer WHERE c_custkey % 5 = 0)
       SELECT coalesce(t.key, s.key) AS key, coalesce(s.subject_id, t.subject_id) AS subject_id,
              CASE WHEN s.key IS NOT NULL THEN s.segment ELSE t.segment END AS segment, t.balance, s.nation
       FROM stored t FULL JOIN given s ON t.key = s.key""",
)
def s8_merge(v: Views) -> DataFrame:
    """Stored nodes take new properties and keep the others; a merge that broke off and is repeated changes nothing else."""
    path = f"{shared_dir(v.spark)}/nodes-{uuid.uuid4().hex}"
    key = F.col("c_custkey").cast("string").alias("key")
    who = v.table("customer")
    first = who.where(F.col("c_custkey") % 3 != 0).select(key, F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    store.merge(first, path, ["key"])
    given = who.where(F.col("c_custkey") % 5 == 0).select(key, F.col("c_custkey").alias("subject_id"), F.lower("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    # Written, but never made valid: what a run leaves that breaks off before its manifest.
    store.prepare_merge(given.withColumn("segment", F.lit("broken off")), path, ["key"])
    for _ in range(2):
        store.merge(given, path, ["key"])
    return store.read(v.spark, path).select("key", "subject_id", "segment", "balance", "nation")


@query(
    "s9_graph_edge_merge",
    """SELECT CAST(l_orderkey AS VARCHAR) AS src_key, 'SUPPLIED' AS rel, CAST(l_suppkey AS VARCHAR) AS dst_key,
              CASE WHEN l_orderkey % 2 = 0 THEN 'later' ELSE 'first' END AS state
       FROM lineitem WHERE l_orderkey % 4 <> 3 OR l_orderkey % 2 = 0 GROUP BY l_orderkey, l_suppkey""",
)
def s9_merge(v: Views) -> DataFrame:
    """Edges are told by both ends and their kind: a second delivery updates those it has and adds new ones."""
    path = f"{shared_dir(v.spark)}/edges-{uuid.uuid4().hex}"
    keys = ["src_key", "rel", "dst_key"]
    ends = v.table("lineitem").select("l_orderkey", F.col("l_orderkey").cast("string").alias("src_key"), F.lit("SUPPLIED").alias("rel"), F.col("l_suppkey").cast("string").alias("dst_key"))
    first = ends.where("l_orderkey % 4 <> 3 AND l_orderkey % 8 <> 2").select(*keys, F.lit("first").alias("state"))
    store.merge(first, path, keys)
    store.merge(ends.where("l_orderkey % 2 = 0").select(*keys, F.lit("later").alias("state")), path, keys)
    return store.read(v.spark, path).select(*keys, "state")


@query("s11_graph_scan_by_label", f"SELECT key, subject_id, {ts('ts')} AS ts FROM g_nodes WHERE label = 'Discharge'")
def s11(v: Views) -> DataFrame:
    return graph_nodes(v).where(F.col("label") == "Discharge").select("key", "subject_id", _text("ts"))


@query(
    "s12_graph_scan_by_property",
    f"""SELECT event_id, label, subject_id, {ts('intime')} AS intime, {ts('outtime')} AS outtime FROM g_windows
        WHERE intime IS NOT NULL AND outtime IS NOT NULL""",
)
def s12(v: Views) -> DataFrame:
    timed = graph_nodes(v).where(F.col("props")["intime"].isNotNull() & F.col("props")["outtime"].isNotNull())
    return timed.select(
        F.col("props")["event_id"].alias("event_id"), "label", "subject_id",
        F.col("props")["intime"].alias("intime"), F.col("props")["outtime"].alias("outtime"),
    )


@query(
    "s15_text_timeline_sink",
    f"""SELECT subject_id, label, key, '[' || {ts('ts')} || '] ' || label || ' ' || key || ' (' ||
               strftime(ts, '%B %d, %Y at %I:%M %p') || ')' AS line
        FROM g_nodes WHERE ts IS NOT NULL ORDER BY subject_id, ts, label, key""",
)
def s15(v: Views) -> DataFrame:
    """Lines of the text report, in order; ``sources.files.text_sink`` writes them."""
    return journey.report_lines(journey.timeline(journey.events(graph_nodes(v)))).drop("ts")


@query(
    "s15_text_files",
    f"""SELECT '[' || {ts('ts')} || '] ' || label || ' ' || key || ' (' || strftime(ts, '%B %d, %Y at %I:%M %p') || ')' AS line
        FROM g_nodes WHERE ts IS NOT NULL""",
)
def s15_files(v: Views) -> DataFrame:
    """The text report as it lies in its files."""
    report = journey.report_lines(journey.timeline(journey.events(graph_nodes(v))))
    target = f"{shared_dir(v.spark)}/report-{uuid.uuid4().hex}"
    files.text_sink(report, target, ["subject_id", "ts", "label", "key"], "line")
    return v.spark.read.text(target).withColumnRenamed("value", "line")


@query(
    "f11_label_exclusion",
    "SELECT label, count(*) AS nodes FROM g_nodes WHERE label NOT IN ('LabEvents') GROUP BY label",
)
def f11(v: Views) -> DataFrame:
    kept = graph_nodes(v).where(~F.col("label").isin(*graph.HELPER_LABELS, "LabEvents"))
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))


@query(
    "p7_node_key",
    """SELECT label, key, label || '_' || CASE label WHEN 'Patient' THEN 'Patient' WHEN 'HospitalAdmission' THEN key
              WHEN 'DRG' THEN split_part(key, '_', 1) WHEN 'Provider' THEN 'Provider'
              ELSE split_part(key, '@', 1) END AS node_key FROM g_nodes""",
)
def p7(v: Views) -> DataFrame:
    return graph_nodes(v).select("label", "key", "node_key")


@query(
    "p19_first_of_fields",
    f"SELECT label, key, {ts('ts')} AS ts FROM g_nodes WHERE ts IS NOT NULL",
)
def p19(v: Views) -> DataFrame:
    return journey.events(graph_nodes(v)).select("label", "key", _text("ts"))


# --- walks -----------------------------------------------------------------------


def roots(v: Views) -> DataFrame:
    return journey.roots(v.patients)


def reach(v: Views) -> DataFrame:
    return v.once("reach", lambda: graph.reachable(graph_edges(v), roots(v)))


@query("g1_patient_subgraph", f"{REACH} SELECT root, node FROM reach")
def g1(v: Views) -> DataFrame:
    return reach(v)


@query(
    "g2_bounded_paths",
    """WITH e AS (SELECT DISTINCT src_label || '|' || src_key AS src, dst_label || '|' || dst_key AS dst, rel FROM g_edges),
       one AS (SELECT r.root, e.* FROM g_roots r JOIN e ON e.src = r.root),
       two AS (SELECT DISTINCT one.root, e.* FROM one JOIN e ON e.src = one.dst),
       three AS (SELECT DISTINCT two.root, e.* FROM two JOIN e ON e.src = two.dst)
       SELECT root, src, rel, dst FROM one UNION SELECT root, src, rel, dst FROM two UNION SELECT root, src, rel, dst FROM three""",
)
def g2(v: Views) -> DataFrame:
    found = graph.path_edges(graph_edges(v), roots(v), 3)
    return found.select(
        "root", graph.address(F.col("src_label"), F.col("src_key")).alias("src"), "rel",
        graph.address(F.col("dst_label"), F.col("dst_key")).alias("dst"),
    )


@query(
    "g3_undirected_reach",
    """WITH both_ways AS (SELECT src, dst FROM g_links UNION SELECT dst, src FROM g_links),
       h0 AS (SELECT root, root AS node FROM g_roots),
       h1 AS (SELECT DISTINCT root, dst AS node FROM h0 JOIN both_ways ON node = src),
       h2 AS (SELECT DISTINCT root, dst AS node FROM h1 JOIN both_ways ON node = src),
       h3 AS (SELECT DISTINCT root, dst AS node FROM h2 JOIN both_ways ON node = src)
       SELECT root, node, min(hops)::BIGINT AS hops FROM (SELECT *, 0 AS hops FROM h0 UNION ALL SELECT *, 1 FROM h1
            UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY root, node""",
)
def g3(v: Views) -> DataFrame:
    return graph.within(graph_edges(v), roots(v), 3)


NODE_AT = "n.label || '|' || n.key"


@query(
    "g4_reachable_named",
    f"{REACH} SELECT DISTINCT r.root, n.label, n.name FROM reach r JOIN g_nodes n ON r.node = {NODE_AT} WHERE n.name IS NOT NULL",
)
def g4(v: Views) -> DataFrame:
    at = graph_nodes(v).withColumn("node", graph.address(F.col("label"), F.col("key")))
    return at.where(F.col("name").isNotNull()).join(reach(v), "node").select("root", "label", "name").distinct()


@query(
    "g5_edge_listing",
    """SELECT e.src_label, a.name AS src_name, e.rel, e.dst_label, b.name AS dst_name, e.src_key, e.dst_key
       FROM (SELECT DISTINCT * FROM g_edges) e JOIN g_nodes a ON e.src_label = a.label AND e.src_key = a.key
       JOIN g_nodes b ON e.dst_label = b.label AND e.dst_key = b.key""",
)
def g5(v: Views) -> DataFrame:
    listed = graph.described(graph_edges(v), graph_nodes(v))
    return listed.select("src_label", "src_name", "rel", "dst_label", "dst_name", "src_key", "dst_key")


@query(
    "g6_node_dedup",
    """WITH keyed AS (SELECT *, label || '_' || CASE label WHEN 'Patient' THEN 'Patient' WHEN 'HospitalAdmission' THEN key
              WHEN 'DRG' THEN split_part(key, '_', 1) WHEN 'Provider' THEN 'Provider'
              ELSE split_part(key, '@', 1) END AS node_key FROM g_nodes)
       SELECT node_key, label, key FROM keyed
       QUALIFY row_number() OVER (PARTITION BY node_key ORDER BY ts NULLS LAST, key) = 1""",
)
def g6(v: Views) -> DataFrame:
    return nodes.first_of_each_key(graph_nodes(v)).select("node_key", "label", "key")


@query(
    "jn14_edge_join",
    """SELECT a.src_label, count(DISTINCT b.dst_key) AS bundles FROM g_edges a JOIN g_edges b
       ON a.dst_label = b.src_label AND a.dst_key = b.src_key
       WHERE a.rel = 'INCLUDED_LAB_EVENTS' AND b.rel = 'CONTAINED_LAB_EVENT' GROUP BY a.src_label""",
)
def jn14(v: Views) -> DataFrame:
    """Stay → batch → bundle, counted per kind of stay."""
    first = graph_edges(v).where(F.col("rel") == "INCLUDED_LAB_EVENTS").select("src_label", F.col("dst_key").alias("batch"))
    second = graph_edges(v).where(F.col("rel") == "CONTAINED_LAB_EVENT").select(F.col("src_key").alias("batch"), "dst_key")
    pairs = first.join(second, "batch").select("src_label", "dst_key").distinct()
    return pairs.groupBy("src_label").agg(F.count(F.lit(1)).alias("bundles"))


@query(
    "jn15_optional_match",
    """SELECT n.key, n.subject_id, e.dst_key AS batch FROM g_nodes n LEFT JOIN g_edges e
       ON e.src_label = n.label AND e.src_key = n.key AND e.rel = 'INCLUDED_LAB_EVENTS' WHERE n.label = 'EmergencyDepartment'""",
)
def jn15(v: Views) -> DataFrame:
    """Emergency visits with their laboratory batch, where there is one."""
    visits = graph_nodes(v).where(F.col("label") == "EmergencyDepartment").select("key", "subject_id")
    of_visit = (F.col("src_label") == "EmergencyDepartment") & (F.col("rel") == "INCLUDED_LAB_EVENTS")
    batches = graph_edges(v).where(of_visit).select(F.col("src_key").alias("key"), F.col("dst_key").alias("batch"))
    return visits.join(batches, "key", "left")


@query(
    "jn16_parent_children",
    """SELECT e.src_label, e.src_key, e.dst_label, count(*) AS child_count,
              string_agg(e.dst_key || ':' || e.rel, '; ' ORDER BY e.dst_key, e.rel) AS children
       FROM (SELECT DISTINCT * FROM g_edges) e JOIN g_nodes n ON e.dst_label = n.label AND e.dst_key = n.key
       WHERE n.ts IS NULL GROUP BY e.src_label, e.src_key, e.dst_label""",
)
def jn16(v: Views) -> DataFrame:
    listed = graph.children(graph_edges(v), graph_nodes(v))
    shown = F.transform("children", lambda c: F.concat_ws(":", c["dst_key"], c["rel"]))
    return listed.withColumn("children", F.array_join(shown, "; "))


# --- rules and reports -----------------------------------------------------------

# A fault of each kind, made from the edges there are.
FAULTS = """faulty AS (SELECT src_label, src_key, rel, dst_label, dst_key FROM (SELECT DISTINCT * FROM g_edges)
    UNION ALL SELECT 'PrescriptionsBatch', src_key, 'HAS_LAB_EVENTS', 'LabEvents', dst_key FROM g_edges WHERE rel = 'INCLUDED_LAB_EVENTS'
    UNION ALL SELECT 'Patient', CAST(subject_id AS VARCHAR), 'ODD', 'LabEvents', dst_key FROM g_edges WHERE rel = 'INCLUDED_LAB_EVENTS'
    UNION ALL SELECT 'LabEvents', src_key, 'CONTAINED_MICROBIOLOGY_EVENT', 'MicrobiologyEvent', dst_key FROM g_edges WHERE rel = 'CONTAINED_LAB_EVENT')"""


def faulty(v: Views) -> DataFrame:
    edges = graph_edges(v).select(*graph.EDGE_KEY, "subject_id")
    labs = edges.where(F.col("rel") == "INCLUDED_LAB_EVENTS")
    mixed = labs.withColumns({"src_label": F.lit("PrescriptionsBatch"), "rel": F.lit("HAS_LAB_EVENTS")})
    odd = labs.withColumns({"src_label": F.lit("Patient"), "src_key": F.col("subject_id").cast("string"), "rel": F.lit("ODD")})
    micro = edges.where(F.col("rel") == "CONTAINED_LAB_EVENT").withColumns(
        {"rel": F.lit("CONTAINED_MICROBIOLOGY_EVENT"), "dst_label": F.lit("MicrobiologyEvent")}
    )
    return edges.unionByName(mixed).unionByName(odd).unionByName(micro)


@query(
    "u3_delete_edges",
    f"""WITH {FAULTS} SELECT src_label, rel, dst_label, count(*) AS kept FROM faulty
        WHERE NOT (src_label = 'PrescriptionsBatch' AND dst_label = 'LabEvents') AND NOT (src_label = 'Patient' AND dst_label = 'LabEvents')
        GROUP BY src_label, rel, dst_label""",
)
def u3(v: Views) -> DataFrame:
    kept = quality.delete_violations(faulty(v))
    return kept.groupBy("src_label", "rel", "dst_label").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "u3_deleted_counts",
    f"""WITH {FAULTS} SELECT CASE src_label WHEN 'Patient' THEN 'parent of LabEvents' ELSE 'prescriptions to labs' END AS rule,
               count(*) AS deleted FROM faulty
        WHERE src_label IN ('PrescriptionsBatch', 'Patient') AND dst_label = 'LabEvents' GROUP BY 1""",
)
def u3_counts(v: Views) -> DataFrame:
    return quality.deleted_counts(faulty(v))


@query(
    "quality_violations",
    f"""WITH {FAULTS} SELECT src_label, src_key, rel, dst_label, dst_key FROM faulty
        WHERE src_label IN ('PrescriptionsBatch', 'Patient') AND dst_label = 'LabEvents'""",
)
def violations(v: Views) -> DataFrame:
    return quality.violations(faulty(v)).select(*graph.EDGE_KEY)


@query(
    "quality_connectivity",
    """SELECT n.label, count(*) AS total, count(e.key) AS connected, count(*) - count(e.key) AS orphaned
       FROM g_nodes n LEFT JOIN (SELECT DISTINCT dst_label AS label, dst_key AS key FROM g_edges) e
       ON n.label = e.label AND n.key = e.key GROUP BY n.label""",
)
def connectivity(v: Views) -> DataFrame:
    return quality.connectivity(graph_nodes(v), graph_edges(v))


@query(
    "a11_distinct_count_pattern",
    "SELECT subject_id, count(DISTINCT dst_label || '|' || dst_key) AS connected_nodes FROM g_edges GROUP BY subject_id",
)
def a11(v: Views) -> DataFrame:
    return quality.connected_per_patient(graph_edges(v))


# Batches of ICU stays lose their edge, as after an interrupted build.
CUT = "cut AS (SELECT DISTINCT * FROM g_edges WHERE NOT (rel = 'INCLUDED_LAB_EVENTS' AND src_label = 'ICUStay'))"


def cut_edges(v: Views) -> DataFrame:
    lost = (F.col("rel") == "INCLUDED_LAB_EVENTS") & (F.col("src_label") == "ICUStay")
    return graph_edges(v).where(~lost)


@query(
    "u4_orphan_cleanup",
    f"""WITH {CUT} SELECT label, key FROM g_nodes n WHERE label <> 'LabEvents' OR EXISTS (
            SELECT 1 FROM cut WHERE rel = 'INCLUDED_LAB_EVENTS' AND dst_label = n.label AND dst_key = n.key)""",
)
def u4(v: Views) -> DataFrame:
    kept = quality.drop_orphans(graph_nodes(v), cut_edges(v), "LabEvents", "INCLUDED_LAB_EVENTS")
    return kept.select("label", "key")


@query(
    "u5_orphan_repair",
    f"""WITH {CUT} SELECT DISTINCT CAST(s.hadm_id AS VARCHAR) AS src_key, n.key AS dst_key, n.subject_id
        FROM g_nodes n JOIN g_windows s ON n.key = s.event_id JOIN flow_admissions a ON s.hadm_id = a.hadm_id AND a.subject_id = n.subject_id
        WHERE n.label = 'LabEvents' AND NOT EXISTS (
            SELECT 1 FROM cut WHERE rel = 'INCLUDED_LAB_EVENTS' AND dst_label = n.label AND dst_key = n.key)""",
)
def u5(v: Views) -> DataFrame:
    owners = v.transfers.select(F.col("transfer_id").cast("string").alias("key"), "hadm_id")
    batches = graph_nodes(v).where(F.col("label") == "LabEvents").join(owners, "key", "left")
    made = quality.repair_orphans(
        batches.select("label", "key", "subject_id", "hadm_id"), cut_edges(v), v.flow_admissions, "INCLUDED_LAB_EVENTS"
    )
    return made.select("src_key", "dst_key", "subject_id")


@query(
    "u9_complete_graph_check",
    """WITH both_ways AS (SELECT src, dst FROM g_links UNION SELECT dst, src FROM g_links),
       h1 AS (SELECT DISTINCT root, dst AS node FROM g_roots JOIN both_ways ON root = src),
       h2 AS (SELECT DISTINCT root, dst AS node FROM h1 JOIN both_ways ON node = src),
       h3 AS (SELECT DISTINCT root, dst AS node FROM h2 JOIN both_ways ON node = src)
       SELECT root, bool_or(split_part(node, '|', 1) = 'LabEvents') AS has_labs FROM (FROM h1 UNION FROM h2 UNION FROM h3)
       GROUP BY root HAVING bool_or(split_part(node, '|', 1) IN ('EmergencyDepartment', 'UnitAdmission', 'ICUStay', 'Discharge', 'HospitalAdmission'))""",
)
def u9(v: Views) -> DataFrame:
    """Patients with at least one event within three steps."""
    return quality.complete_graphs(graph_edges(v), roots(v))


# --- journeys --------------------------------------------------------------------


@query(
    "j1_journey_events",
    f"""{REACH} SELECT n.subject_id, n.label, n.key, {ts('n.ts')} AS ts FROM reach r JOIN g_nodes n ON r.node = {NODE_AT}
        WHERE n.ts IS NOT NULL ORDER BY n.subject_id, n.ts, n.label, n.key""",
)
def j1(v: Views) -> DataFrame:
    at = journey.events(graph_nodes(v)).withColumn("node", graph.address(F.col("label"), F.col("key")))
    mine = at.join(reach(v), "node")
    return journey.timeline(mine).select("subject_id", "label", "key", _text("ts"))


GAPS = """gaps AS (SELECT *, lag(ts) OVER (PARTITION BY subject_id ORDER BY ts, label, key) AS prev_ts FROM g_nodes WHERE ts IS NOT NULL)"""


@query(
    "j2_journey_with_gaps",
    f"""WITH {GAPS} SELECT subject_id, label, key, {ts('ts')} AS ts, {ts('prev_ts')} AS prev_ts, {gap('prev_ts', 'ts')} AS gap,
               CASE WHEN label IN ('EmergencyDepartment', 'HospitalAdmission') THEN {gap('prev_ts', 'ts')} END AS report_gap
        FROM gaps""",
)
def j2(v: Views) -> DataFrame:
    seen = journey.with_gaps(journey.events(graph_nodes(v)))
    return seen.select("subject_id", "label", "key", _text("ts"), _text("prev_ts"), "gap", "report_gap")


@query("w9_time_gap", f"WITH {GAPS} SELECT label, key, {gap('prev_ts', 'ts')} AS gap FROM gaps")
def w9(v: Views) -> DataFrame:
    return journey.with_gaps(journey.events(graph_nodes(v))).select("label", "key", "gap")


@query(
    "o4_timeline_sort",
    f"""SELECT subject_id, label, key, {ts('ts')} AS ts FROM g_nodes WHERE ts IS NOT NULL ORDER BY subject_id, g_nodes.ts, label, key""",
)
def o4(v: Views) -> DataFrame:
    return journey.timeline(journey.events(graph_nodes(v))).select("subject_id", "label", "key", _text("ts"))


@query(
    "j3_patient_list",
    """SELECT subject_id, gender, anchor_age, count(hadm_id) AS total_number_of_admissions
       FROM patients LEFT JOIN admissions USING (subject_id) GROUP BY ALL ORDER BY subject_id""",
)
def j3(v: Views) -> DataFrame:
    return journey.patient_list(v.patients, v.admissions)


@query(
    "s14_json_export",
    f"""SELECT label, key, subject_id, {ts('ts')} AS ts FROM g_nodes""",
)
def s14(v: Views) -> DataFrame:
    """Nodes as JSON documents, written, read back and taken apart again."""
    from wardgraph.session import shared_dir
    from wardgraph.sources import files

    def export():
        path = f"{shared_dir(v.spark)}/nodes-json-{uuid.uuid4().hex}"
        shown = graph_nodes(v).withColumn("ts", format_ts(F.col("ts")))
        files.json_export(shown, path)
        schema = "label string, key string, subject_id bigint, name string, ts string, node_key string, props map<string,string>"
        return v.spark.read.schema(schema).json(path)

    return v.once("json_export", export).select("label", "key", "subject_id", "ts")
