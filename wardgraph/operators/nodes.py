"""Node frames: one table per label, and the one table a walk reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgraph.functions.text import node_key
from wardgraph.functions.times import format_ts

# The fields that give the time of a node, in order of preference.
TIME_FIELDS = {
    "HospitalAdmission": ["admittime", "dischtime"],
    "EmergencyDepartment": ["intime", "outtime"],
    "UnitAdmission": ["intime", "outtime"],
    "ICUStay": ["intime", "outtime"],
    "Discharge": ["outtime", "intime"],
    "Prescription": ["starttime"],
    "Procedures": ["time"],
    "LabEvent": ["charttime"],
    "MicrobiologyEvent": ["charttime"],
    "ChartEvent": ["charttime"],
    "PreviousPrescriptionMeds": ["charttime"],
    "AdministeredMeds": ["charttime"],
    "InitialAssessment": ["charttime"],
}


def node_time(label: str, frame: DataFrame) -> Column:
    """First known time field of a label; text is parsed, null where it is no time."""
    fields = [f for f in TIME_FIELDS.get(label, []) if f in frame.columns]
    return F.coalesce(*[F.col(f).try_cast("timestamp_ntz") for f in fields], F.lit(None).cast("timestamp_ntz"))


def _as_text(field) -> Column:
    c = F.col(field.name)
    kind = field.dataType.simpleString()
    if kind.startswith("array"):
        return F.array_join(c.cast("array<string>"), "; ")
    if kind.startswith("timestamp"):
        return format_ts(c)
    if kind.startswith(("map", "struct")):
        return F.to_json(c)
    return c.cast("string")


def unify(frames: Mapping[str, DataFrame]) -> DataFrame:
    """All labels in one table: label, key, subject_id, name, ts, node_key and props.

    ``props`` holds every other column of the label as text, nulls left out.
    """
    out = None
    for label, frame in frames.items():
        fields = [f for f in frame.schema.fields if f.name not in ("key", "subject_id", "label")]
        pairs = [x for f in fields for x in (F.lit(f.name), _as_text(f))]
        props = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        known = [F.col(c).cast("string") for c in ("event_id", "hadm_id", "stay_id", "name") if c in frame.columns]
        one = frame.select(
            (F.col("label") if "label" in frame.columns else F.lit(label)).alias("label"),
            F.col("key").cast("string").alias("key"),
            F.col("subject_id").cast("bigint").alias("subject_id"),
            (F.col("name") if "name" in frame.columns else F.lit(label)).alias("name"),
            node_time(label, frame).alias("ts"),
            node_key(F.lit(label), *known).alias("node_key"),
            props.alias("props"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def first_of_each_key(nodes: DataFrame) -> DataFrame:
    """One node per node_key: the first by time, then key."""
    whole = F.struct(*nodes.columns)
    never = F.lit("9999-12-31").cast("timestamp_ntz")
    position = F.struct(F.coalesce("ts", never).alias("t"), F.col("key"))
    return nodes.groupBy("node_key").agg(F.min_by(whole, position).alias("_n")).select("_n.*")
