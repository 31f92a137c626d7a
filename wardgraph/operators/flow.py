"""Patient flow: emergency visits, unit stays, admissions and what led to what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgraph.functions.clinical import UNKNOWN, or_default
from wardgraph.functions.times import period_string
from wardgraph.operators import ordered

# Event types, the labels of their nodes and the names of edges into them.
EVENT_LABELS = {
    "ed": "EmergencyDepartment",
    "discharge": "Discharge",
    "admit": "UnitAdmission",
    "transfer": "UnitAdmission",
}
EVENT_EDGES = {
    "discharge": "LED_TO_DISCHARGE",
    "transfer": "LED_TO_UNIT_ADMISSION",
    "admit": "LED_TO_UNIT_ADMISSION",
    "ed": "LED_TO_ED",
}
UNIT_EVENTS = ["admit", "transfer"]


def _choose(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    chosen = F.when(F.lit(False), F.lit(None))
    for k, v in table.items():
        chosen = chosen.when(key == k, F.lit(v))
    return chosen.otherwise(otherwise)


def event_label(eventtype: Column) -> Column:
    return _choose(eventtype, EVENT_LABELS, F.initcap(eventtype))


def event_edge(next_type: Column) -> Column:
    known = F.lower(or_default(next_type, "unknown"))
    return _choose(known, EVENT_EDGES, F.concat(F.lit("LED_TO_"), F.upper(known)))


def event_name(eventtype: Column, careunit: Column) -> Column:
    return (
        F.when(eventtype == "discharge", F.lit("Discharge"))
        .when(eventtype.isin(UNIT_EVENTS), careunit)
        .otherwise(event_label(eventtype))
    )


def event_id(c: Column) -> Column:
    return c.cast("bigint").cast("string")


# --- sequence numbers --------------------------------------------------------


def ed_sequence(edstays: DataFrame) -> DataFrame:
    """Emergency stays of a patient numbered by arrival."""
    return ordered.along(edstays, ["subject_id"], ["intime", "stay_id"], ordered.number("ed_seq_num"))


def ed_transfers_outside(transfers: DataFrame, edstays: DataFrame) -> DataFrame:
    """Emergency rows of the transfer table that have no emergency stay."""
    known = edstays.select("subject_id", F.col("stay_id").alias("transfer_id"))
    return transfers.where(F.lower("eventtype") == "ed").join(
        known, ["subject_id", "transfer_id"], "left_anti"
    )


def ed_sequence_continued(transfers: DataFrame, edstays: DataFrame) -> DataFrame:
    """Those rows numbered on from the patient's number of emergency stays."""
    counts = edstays.groupBy("subject_id").agg(F.count(F.lit(1)).alias("_stays"))
    numbered = ordered.along(
        ed_transfers_outside(transfers, edstays),
        ["subject_id"],
        ["intime", "transfer_id"],
        ordered.number("_n"),
    )
    return (
        numbered.join(counts, "subject_id", "left")
        .withColumn("ed_seq_num", F.col("_n") + F.coalesce("_stays", F.lit(0)))
        .drop("_n", "_stays")
    )


def admission_sequence(admissions: DataFrame) -> DataFrame:
    """Admissions of a patient numbered by time of admission."""
    return ordered.along(
        admissions, ["subject_id"], ["admittime", "hadm_id"], ordered.number("admission_seq_num")
    )


def admission_counts(admissions: DataFrame) -> DataFrame:
    return admissions.groupBy("subject_id").agg(F.count(F.lit(1)).alias("total_number_of_admissions"))


# --- unit stays --------------------------------------------------------------


def with_service(transfers: DataFrame, services: DataFrame) -> DataFrame:
    """Service that began exactly when the transfer did.

    Services of one instant are reduced to one, so a transfer is never
    doubled; admissions that are unknown on both sides match each other.
    """
    one = services.groupBy("subject_id", "hadm_id", "transfertime").agg(
        F.max("curr_service").alias("service_given")
    )
    t, s = transfers.alias("t"), one.alias("s")
    same = (
        (F.col("t.subject_id") == F.col("s.subject_id"))
        & F.col("t.hadm_id").eqNullSafe(F.col("s.hadm_id"))
        & (F.col("t.intime") == F.col("s.transfertime"))
    )
    return t.join(s, same, "left").select("t.*", "s.service_given")


def continuous_stays(transfers: DataFrame) -> DataFrame:
    """Transfer rows of an admission with unbroken stays in one unit merged.

    A unit row is merged into the one just before it when both are in the
    same unit and it begins exactly when the other ends. The first row gives
    the identifier, the type and the start, the last one the end.
    """
    rows = transfers.where(F.col("hadm_id").isNotNull()).withColumns(
        {
            "eventtype": F.lower(or_default(F.col("eventtype"), "unknown")),
            "careunit": or_default(F.col("careunit"), UNKNOWN),
        }
    )
    if "service_given" not in rows.columns:
        rows = rows.withColumn("service_given", F.lit(None).cast("string"))

    def joins_previous(prev, row):
        return (
            prev("eventtype").isin(UNIT_EVENTS)
            & row("eventtype").isin(UNIT_EVENTS)
            & (prev("careunit") == row("careunit"))
            & (prev("outtime") == row("intime"))
        )

    carried = ["transfer_id", "eventtype", "careunit", "intime", "outtime", "service_given"]
    labelled = ordered.runs(
        rows.select("subject_id", "hadm_id", *carried),
        ["subject_id", "hadm_id"],
        ["intime", "transfer_id"],
        "transfer_id",
        joins_previous,
        carried,
    )
    position = F.struct("intime", "transfer_id")
    # One aggregate for the whole first row: each carries the position beside its value.
    first = F.min_by(F.struct("transfer_id", "eventtype", "careunit", "service_given"), position).alias("_first")
    return (
        labelled.groupBy("subject_id", "hadm_id", "run_id")
        .agg(
            first,
            F.min("intime").alias("intime"),
            F.max_by("outtime", position).alias("outtime"),
            F.count(F.lit(1)).alias("merged_rows"),
        )
        .select(
            "subject_id", "hadm_id", "run_id", event_id(F.col("_first.transfer_id")).alias("event_id"),
            "_first.eventtype", "_first.careunit", "_first.service_given", "intime", "outtime", "merged_rows",
        )
        .withColumns(
            {
                "label": event_label(F.col("eventtype")),
                "name": event_name(F.col("eventtype"), F.col("careunit")),
                "period": period_string(F.col("intime"), F.col("outtime")),
            }
        )
        .drop("run_id")
    )


def with_previous_stay(stays: DataFrame) -> DataFrame:
    """Each merged stay with the one before it in its admission."""
    names = ["event_id", "eventtype", "careunit", "intime", "outtime", "label"]
    seq = stays.withColumn("_tie", F.col("event_id").cast("bigint"))
    linked = ordered.along(
        seq, ["subject_id", "hadm_id"], ["intime", "_tie"], ordered.previous("_prev", fields=names)
    )
    return linked.select(
        *stays.columns, *[F.col("_prev")[n].alias(f"prev_{n}") for n in names]
    )


def flow_edges(stays_with_previous: DataFrame) -> DataFrame:
    """Edge from the previous stay into each stay that is no emergency visit."""
    return stays_with_previous.where(
        F.col("prev_event_id").isNotNull() & (F.col("eventtype") != "ed")
    ).select(
        F.col("prev_label").alias("src_label"),
        F.col("prev_event_id").alias("src_key"),
        event_edge(F.col("eventtype")).alias("rel"),
        F.col("label").alias("dst_label"),
        F.col("event_id").alias("dst_key"),
        "subject_id",
    )


def relabel_icu(stays: DataFrame, icustays: DataFrame) -> DataFrame:
    """Unit stays that are intensive-care stays become ICUStay and gain its columns."""
    icu = icustays.select(
        event_id(F.col("stay_id")).alias("event_id"),
        "first_careunit",
        "last_careunit",
        "los",
        F.lit(True).alias("_icu"),
    )
    return (
        stays.join(icu, "event_id", "left")
        .withColumn(
            "label",
            F.when(F.col("_icu") & (F.col("label") == "UnitAdmission"), F.lit("ICUStay")).otherwise(
                F.col("label")
            ),
        )
        .drop("_icu")
    )


def unmatched_icu(stays: DataFrame, icustays: DataFrame) -> DataFrame:
    """Intensive-care stays that have no unit stay."""
    units = stays.where(F.col("label").isin("UnitAdmission", "ICUStay")).select("event_id")
    return icustays.withColumn("event_id", event_id(F.col("stay_id"))).join(units, "event_id", "left_anti")


# --- how an admission began --------------------------------------------------


def opening_events(edstays: DataFrame, transfers: DataFrame) -> DataFrame:
    """Every event that may have opened an admission, from both sources."""
    cols = ["subject_id", "hadm_id", "event_id", "eventtype", "label", "intime", "outtime"]
    from_ed = edstays.withColumns(
        {
            "event_id": event_id(F.col("stay_id")),
            "eventtype": F.lit("ed"),
            "label": F.lit(EVENT_LABELS["ed"]),
        }
    ).select(*cols)
    ed_rows = ed_transfers_outside(transfers, edstays)
    units = transfers.where(F.lower("eventtype").isin(UNIT_EVENTS))
    from_transfers = ed_rows.unionByName(units).withColumns(
        {
            "event_id": event_id(F.col("transfer_id")),
            "eventtype": F.lower("eventtype"),
            "label": event_label(F.lower("eventtype")),
        }
    )
    both = from_ed.unionByName(from_transfers.select(*cols))
    return both.where(F.col("intime").isNotNull() & F.col("hadm_id").isNotNull())


def first_event(edstays: DataFrame, transfers: DataFrame) -> DataFrame:
    """Earliest event of each admission."""
    position = F.struct("intime", F.col("event_id").cast("bigint").alias("n"))
    row = F.struct("event_id", "eventtype", "label", "intime", "outtime")
    return (
        opening_events(edstays, transfers)
        .groupBy("subject_id", "hadm_id")
        .agg(F.min_by(row, position).alias("_first"))
        .select("subject_id", "hadm_id", "_first.*")
    )


def admission_timing(eventtype: Column, intime: Column, outtime: Column, admittime: Column) -> Column:
    """Name of the edge from the first event to the admission; null without an admission time."""
    during = admittime.between(intime, outtime)
    relation = (
        F.when(eventtype != "ed", F.lit("LED_TO_ADMISSION"))
        .when(during, F.lit("LED_TO_ADMISSION_DURING_STAY"))
        .when(admittime > outtime, F.lit("LED_TO_ADMISSION_AFTER_DISCHARGE"))
        .otherwise(F.lit("LED_TO_ADMISSION"))
    )
    return F.when(admittime.isNotNull() & intime.isNotNull(), relation)


def admission_links(first: DataFrame, admissions: DataFrame) -> DataFrame:
    """Edge from the first event of an admission to the admission."""
    linked = first.join(
        admissions.select("subject_id", "hadm_id", "admittime"), ["subject_id", "hadm_id"]
    )
    return linked.withColumn(
        "rel",
        admission_timing(F.col("eventtype"), F.col("intime"), F.col("outtime"), F.col("admittime")),
    ).where(F.col("rel").isNotNull())


# --- what follows a discharge ------------------------------------------------


def next_ed_visit(discharges: DataFrame, visits: DataFrame, grain: str = ordered.GRAIN) -> DataFrame:
    """First emergency visit of the patient strictly after each discharge.

    ``discharges`` and ``visits`` have subject_id, event_id and intime. Both
    are laid on one time line; a visit at the very moment of the discharge
    sorts before it and so is not taken.
    """
    line = discharges.select("subject_id", "event_id", "intime", F.lit(1).alias("_kind")).unionByName(
        visits.select("subject_id", "event_id", "intime", F.lit(0).alias("_kind"))
    )
    line = line.where(F.col("intime").isNotNull())
    visit = F.when(F.col("_kind") == 0, F.struct("event_id", "intime"))
    seen = ordered.along(
        line,
        ["subject_id"],
        ["intime", "_kind", "event_id"],
        ordered.next_known("_next", visit),
        grain=grain,
    )
    return seen.where((F.col("_kind") == 1) & F.col("_next").isNotNull()).select(
        "subject_id",
        F.col("event_id").alias("discharge_id"),
        F.col("intime").alias("discharge_time"),
        F.col("_next.event_id").alias("ed_event_id"),
        F.col("_next.intime").alias("ed_time"),
        period_string(F.col("intime"), F.col("_next.intime")).alias("gap"),
    )


def known_unit(careunit: Column) -> Column:
    # Names that stand for no unit.
    return F.when(~careunit.isin("UNKNOWN", "Unknown", "N/A"), careunit)


def discharge_unit(events: DataFrame) -> DataFrame:
    """Discharges without a known unit take the latest known one before them.

    ``events`` has subject_id, event_id, eventtype, careunit and intime.
    """
    line = events.withColumn("_tie", F.col("event_id").cast("bigint"))
    seen = ordered.along(
        line,
        ["subject_id"],
        ["intime", "_tie"],
        ordered.last_known("_unit", known_unit(F.col("careunit"))),
    )
    resolved = F.when(
        F.col("eventtype") == "discharge", F.coalesce(known_unit(F.col("careunit")), F.col("_unit"), F.col("careunit"))
    ).otherwise(F.col("careunit"))
    return seen.withColumn("careunit", resolved).select(*events.columns)
