"""Rules on edges, and reports on what is connected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgraph.operators import graph
from wardgraph.operators.graph import EDGE_KEY

# Groups of labels that must not be linked to one another.
APART = {
    "prescriptions": ["Prescription", "PrescriptionsBatch"],
    "procedures": ["Procedures", "ProceduresBatch"],
    "labs": ["LabEvent", "LabEvents"],
    "microbiology": ["MicrobiologyEvent"],
    "charts": ["ChartEvent", "ChartEventBatch"],
}
STAY_LABELS = ["EmergencyDepartment", "UnitAdmission", "ICUStay", "Discharge", "HospitalAdmission"]
# Edges between two such groups, or inside one, that are meant.
MEANT = [
    ("PrescriptionsBatch", "CONTAINED_PRESCRIPTION", "Prescription"),
    ("ProceduresBatch", "CONTAINED_PROCEDURE", "Procedures"),
    ("LabEvents", "CONTAINED_LAB_EVENT", "LabEvent"),
    ("LabEvents", "CONTAINED_MICROBIOLOGY_EVENT", "MicrobiologyEvent"),
    ("ChartEventBatch", "CONTAINED_CHART_EVENT", "ChartEvent"),
]
# The only labels a batch may hang off.
PARENTS = {
    "PrescriptionsBatch": STAY_LABELS,
    "ProceduresBatch": STAY_LABELS,
    "LabEvents": STAY_LABELS,
    "ChartEventBatch": ["ICUStay"],
}


def _group(label):
    out = F.when(F.lit(False), F.lit(None))
    for name, labels in APART.items():
        out = out.when(label.isin(labels), F.lit(name))
    return out


def broken_rule(edges: DataFrame) -> DataFrame:
    """Edges with the rule they break in ``rule``; null for edges that are fine."""
    src, rel, dst = F.col("src_label"), F.col("rel"), F.col("dst_label")
    meant = F.lit(False)
    for s, r, d in MEANT:
        meant = meant | ((src == s) & (rel == r) & (dst == d))
    rule = F.when(meant, F.lit(None)).when(
        _group(src).isNotNull() & _group(dst).isNotNull(), F.concat_ws(" to ", _group(src), _group(dst))
    )
    for batch, parents in PARENTS.items():
        rule = rule.when((dst == batch) & ~src.isin(parents), F.lit(f"parent of {batch}"))
    return edges.withColumn("rule", rule)


def violations(edges: DataFrame) -> DataFrame:
    return broken_rule(edges).where(F.col("rule").isNotNull())


def delete_violations(edges: DataFrame) -> DataFrame:
    """Edges that break no rule. One pass; no join and no shuffle."""
    return broken_rule(edges).where(F.col("rule").isNull()).drop("rule")


def deleted_counts(edges: DataFrame) -> DataFrame:
    return violations(edges).groupBy("rule").agg(F.count(F.lit(1)).alias("deleted"))


def allowed_pairs(spark: SparkSession) -> DataFrame:
    """The meant edges as a table."""
    return spark.createDataFrame(MEANT, "src_label string, rel string, dst_label string")


def without_parent(nodes: DataFrame, edges: DataFrame, rel: str | None = None) -> DataFrame:
    """Nodes that no edge (of one kind) leads to."""
    into = edges if rel is None else edges.where(F.col("rel") == rel)
    keys = into.select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key"))
    return nodes.join(keys, ["label", "key"], "left_anti")


def drop_orphans(nodes: DataFrame, edges: DataFrame, label: str, rel: str) -> DataFrame:
    """Nodes without those of one label that lack an incoming edge of one kind."""
    into = edges.where(F.col("rel") == rel).select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key"))
    mine = nodes.where(F.col("label") == label).join(into, ["label", "key"], "left_semi")
    return nodes.where(F.col("label") != label).unionByName(mine.select(*nodes.columns))


def repair_orphans(batches: DataFrame, edges: DataFrame, admissions: DataFrame, rel: str) -> DataFrame:
    """New edges from the admission to batches of that admission that hang off nothing.

    ``batches`` has label, key, subject_id and hadm_id.
    """
    lost = without_parent(batches, edges, rel).where(F.col("hadm_id").isNotNull())
    known = admissions.select("hadm_id", "subject_id")
    return lost.join(known, ["hadm_id", "subject_id"]).select(
        F.lit("HospitalAdmission").alias("src_label"),
        F.col("hadm_id").cast("string").alias("src_key"),
        F.lit(rel).alias("rel"),
        F.col("label").alias("dst_label"),
        F.col("key").alias("dst_key"),
        "subject_id",
    )


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per label: nodes in all, with an incoming edge, and without."""
    into = edges.select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key")).distinct()
    marked = nodes.select("label", "key").join(into.withColumn("_in", F.lit(1)), ["label", "key"], "left")
    return marked.groupBy("label").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("_in").alias("connected"),
        F.count(F.when(F.col("_in").isNull(), 1)).alias("orphaned"),
    )


def connected_per_patient(edges: DataFrame) -> DataFrame:
    """Different nodes that each patient's edges lead to."""
    # Nodes are made distinct before the count by patient, so that a patient
    # with very many edges is counted in parts.
    nodes = edges.select("subject_id", "dst_label", "dst_key").distinct()
    return nodes.groupBy("subject_id").agg(F.count(F.lit(1)).alias("connected_nodes"))


def complete_graphs(edges: DataFrame, patients: DataFrame, steps: int = 3) -> DataFrame:
    """(root, has_labs): patients whose graph has an event within some steps, and whether it has lab results.

    ``patients`` has ``root``, the address of a patient's node. A patient that is
    not in the result has not been loaded whole.
    """
    near = graph.within(edges, patients, steps)
    label = F.substring_index("node", "|", 1)
    marked = near.groupBy("root").agg(
        F.max(label == "LabEvents").alias("has_labs"), F.max(label.isin(STAY_LABELS)).alias("_events")
    )
    return marked.where("_events").drop("_events")


def report(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Connectivity per label, rule violations, and edges whose end is missing."""
    known = nodes.select("label", "key")
    dangling = edges.join(
        known.select(F.col("label").alias("dst_label"), F.col("key").alias("dst_key")), ["dst_label", "dst_key"], "left_anti"
    ).unionByName(
        edges.join(known.select(F.col("label").alias("src_label"), F.col("key").alias("src_key")), ["src_label", "src_key"], "left_anti"),
    )
    return {
        "connectivity": connectivity(nodes, edges),
        "violations": violations(edges),
        "dangling": dangling.select(*EDGE_KEY),
    }
