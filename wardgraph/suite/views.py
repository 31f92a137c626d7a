"""The driver tables seen as hospital tables.

``sql_views`` holds the same mapping in SQL. Column names are those of the
hospital schemas in ``wardgraph.sources.schemas``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgraph.operators import ordered
from wardgraph.session import prepare, written

_written: dict[tuple[str, str, str], DataFrame] = {}


def _add_days(ts: str, days: str) -> F.Column:
    return F.expr(f"timestampadd(DAY, cast({days} as int), {ts})")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def once(self, name: str, build) -> DataFrame:
        """A derived table, written to the shared folder on first use in a session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written:
            _written[key] = written(build(), name)
        return _written[key]

    # --- patients and admissions --------------------------------------------

    @cached_property
    def patients(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("subject_id"),
            F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
            (20 + F.col("c_custkey") % 60).alias("anchor_age"),
            (2100 + F.col("c_nationkey")).cast("bigint").alias("anchor_year"),
            F.col("c_mktsegment").alias("anchor_year_group"),
            F.when(F.col("c_acctbal") < 0, "2150-01-01").alias("dod"),
        )

    @cached_property
    def admissions(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("hadm_id"),
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderdate").alias("admittime"),
            _add_days("o_orderdate", "o_orderkey % 10").alias("dischtime"),
            F.col("o_orderpriority").alias("admission_type"),
            F.col("o_orderstatus").alias("discharge_location"),
            F.when(F.col("o_orderstatus") == "P", F.lit("  "))
            .when(F.col("o_orderpriority") != "2-HIGH", F.concat(F.lit(" P"), (F.col("o_custkey") % 97).cast("string")))
            .alias("admit_provider_id"),
        )

    # --- patient flow, from the events --------------------------------------

    @cached_property
    def flow_events(self) -> DataFrame:
        """Events with what their time line says: admission number, neighbours."""

        def build():
            events = self.table("events").select(
                "event_id",
                "ts",
                "user_id",
                "event_type",
                "value",
                F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            )
            moved = F.col("event_type") != "click"
            return ordered.along(
                events,
                ["user_id"],
                ["ts", "event_id"],
                ordered.total_before("n_before", (F.col("event_type") == "purchase").cast("bigint")),
                ordered.last_known("prev_type", F.when(moved, F.col("event_type"))),
                ordered.next_known("next_ts", F.when(moved, F.col("ts"))),
            )

        return self.once("flow_events", build)

    @cached_property
    def transfers(self) -> DataFrame:
        k, kind = F.col("k"), F.col("event_type")
        return self.flow_events.where(kind != "click").select(
            F.col("event_id").alias("transfer_id"),
            F.col("user_id").alias("subject_id"),
            F.when((kind == "error") & (k < 20), F.lit(None))
            .otherwise(F.col("user_id") * 100000 + F.col("n_before"))
            .alias("hadm_id"),
            F.when(kind == "signup", "admit")
            .when(kind == "view", "transfer")
            .when(kind == "purchase", "discharge")
            .otherwise("ed")
            .alias("eventtype"),
            F.when(k < 95, F.concat(F.lit("unit_"), (k % 3).cast("string"))).alias("careunit"),
            F.col("ts").alias("intime"),
            F.when(kind != "purchase", F.col("next_ts")).alias("outtime"),
            "value",
            "k",
        )

    @cached_property
    def flow_admissions(self) -> DataFrame:
        """One admission per (patient, admission number) of the events."""
        return (
            self.transfers.where(F.col("hadm_id").isNotNull())
            .groupBy("subject_id", "hadm_id")
            .agg(F.min(F.when(F.col("eventtype") == "admit", F.col("intime"))).alias("admittime"),
                 F.max(F.when(F.col("eventtype") == "discharge", F.col("intime"))).alias("dischtime"))
        )

    @cached_property
    def services(self) -> DataFrame:
        units = self.transfers.where(F.col("eventtype").isin("admit", "transfer"))
        rows = [
            units.where(F.col("value") > 10).withColumn(
                "curr_service", F.concat(F.lit("S"), (F.col("k") % 4).cast("string"))
            ),
            units.where(F.col("value") > 50).withColumn("curr_service", F.lit("R9")),
        ]
        return rows[0].unionByName(rows[1]).select(
            "subject_id", "hadm_id", F.col("intime").alias("transfertime"), "curr_service"
        )

    @cached_property
    def edstays(self) -> DataFrame:
        k = F.col("k")
        return self.transfers.where((F.col("eventtype") == "ed") & (F.col("value") > 15)).select(
            "subject_id",
            F.col("transfer_id").alias("stay_id"),
            "hadm_id",
            "intime",
            "outtime",
            F.when(k < 25, "HOME").when(k < 50, "ADMITTED").when(k < 60, "Left without being seen").alias("disposition"),
            F.when(k % 2 == 0, "AMBULANCE").otherwise("WALK IN").alias("arrival_transport"),
        )

    @cached_property
    def icustays(self) -> DataFrame:
        return self.transfers.where(
            F.col("eventtype").isin("admit", "transfer") & (F.col("careunit") == "unit_0")
        ).select(
            "subject_id",
            "hadm_id",
            F.col("transfer_id").alias("stay_id"),
            F.col("careunit").alias("first_careunit"),
            F.concat(F.lit("unit_"), (F.col("k") % 2).cast("string")).alias("last_careunit"),
            "intime",
            "outtime",
            F.col("value").alias("los"),
        )

    @cached_property
    def stays(self) -> DataFrame:
        """Merged stays of the flow; written once, as a build would do."""
        from wardgraph.operators import flow

        return self.once(
            "stays", lambda: flow.continuous_stays(flow.with_service(self.transfers, self.services))
        )

    @cached_property
    def stay_windows(self) -> DataFrame:
        """Anything with a start and an end: merged stays and emergency stays alike."""
        from wardgraph.operators import flow

        merged = flow.relabel_icu(self.stays, self.icustays).select(
            "subject_id", "hadm_id", "event_id", "label", "intime", "outtime"
        )
        only_ed = self.transfers.where(F.col("hadm_id").isNull()).select(
            "subject_id",
            "hadm_id",
            F.col("transfer_id").cast("string").alias("event_id"),
            F.lit("EmergencyDepartment").alias("label"),
            "intime",
            "outtime",
        )
        return merged.unionByName(only_ed)

    # --- facts and dictionaries ---------------------------------------------

    @cached_property
    def d_items(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("itemid"),
            F.col("p_name").alias("label"),
            F.col("p_brand").alias("fluid"),
            F.col("p_type").alias("category"),
            F.concat(F.lit("u"), F.col("p_size").cast("string")).alias("unitname"),
            F.when(F.col("p_type") == "ECONOMY", "Text").otherwise("Numeric").alias("param_type"),
            F.col("p_size").cast("double").alias("lownormalvalue"),
            (F.col("p_size") * 10.0).alias("highnormalvalue"),
        )

    @cached_property
    def labevents(self) -> DataFrame:
        """Three results per click, taken at the same second."""
        hadm = F.col("user_id") * 100000 + F.col("n_before") - F.when(F.col("prev_type") == "purchase", 1).otherwise(0)
        taken = self.flow_events.where(F.col("event_type") == "click").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
        item = (F.col("k") + F.col("j")) % 100
        value = F.col("value") + F.col("j") * 0.5
        return taken.select(
            (F.col("event_id") * 3 + F.col("j")).alias("labevent_id"),
            F.col("user_id").alias("subject_id"),
            item.alias("itemid"),
            F.when(F.col("prev_type").isNotNull(), hadm).alias("hadm_id"),
            F.date_trunc("second", "ts").cast("timestamp_ntz").alias("charttime"),
            F.when(item >= 5, value).alias("valuenum"),
            F.when(item % 2 == 0, "mg").alias("valueuom"),
            F.when(item <= 90, item * 0.25).alias("ref_range_lower"),
            (item * 0.75 + 5).alias("ref_range_upper"),
            F.when(value > 40, "abnormal").alias("flag"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with the patient and the start of their admission."""
        o = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"
        )
        return self.table("lineitem").join(o, "l_orderkey")

    @cached_property
    def admission_windows(self) -> DataFrame:
        """Orders as stays: without admission when partial, without end when low."""
        return self.table("orders").select(
            F.col("o_custkey").alias("subject_id"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("hadm_id"),
            F.col("o_orderkey").cast("string").alias("event_id"),
            F.lit("UnitAdmission").alias("label"),
            F.col("o_orderdate").alias("intime"),
            F.when(F.col("o_orderpriority") != "5-LOW", _add_days("o_orderdate", "o_orderkey % 10")).alias("outtime"),
        )

    @cached_property
    def prescriptions(self) -> DataFrame:
        return self.lines.select(
            F.col("o_custkey").alias("subject_id"),
            F.when((F.col("o_orderstatus") != "P") | (F.col("l_returnflag") == "R"), F.col("l_orderkey")).alias("hadm_id"),
            F.when(
                (F.col("l_linestatus") == "O") | (F.col("l_returnflag") != "N"),
                F.concat_ws("-", "l_orderkey", "l_linenumber"),
            ).alias("poe_id"),
            _add_days("o_orderdate", "l_quantity % 8").alias("starttime"),
            F.when(F.col("l_partkey") % 50 != 0, F.concat(F.lit("drug "), F.col("l_partkey").cast("string"))).alias("drug"),
            F.when(F.col("l_linenumber") < 6, F.col("l_linenumber").cast("string")).alias("dose_val_rx"),
            F.when(F.col("l_linenumber") < 7, "mg").alias("dose_unit_rx"),
            F.when(F.col("l_returnflag") != "A", F.concat(F.lit("route "), F.col("l_returnflag"))).alias("route"),
            F.round(F.col("l_discount") * 100).alias("doses_per_24_hrs"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_extendedprice",
        )

    @cached_property
    def microbiology(self) -> DataFrame:
        flag, status, n = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber").cast("string")
        return self.lines.select(
            F.col("o_custkey").alias("subject_id"),
            F.when(F.col("o_orderstatus") != "P", F.col("l_orderkey")).alias("hadm_id"),
            F.when((flag != "N") | (status != "O"), F.col("l_orderkey") * 10 + F.col("l_linenumber") % 2).alias("micro_specimen_id"),
            _add_days("o_orderdate", "l_quantity % 8").alias("charttime"),
            F.concat(F.lit("spec "), (F.col("l_linenumber") % 2).cast("string")).alias("spec_type_desc"),
            F.concat(F.lit("test "), status).alias("test_name"),
            F.when(flag == "R", F.concat(F.lit("ORG "), n)).alias("org_name"),
            F.when(F.col("l_linenumber") < 6, F.concat(F.lit("ab "), (F.col("l_partkey") % 7).cast("string"))).alias("ab_name"),
            F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("dilution_value"),
            status.alias("interpretation"),
            F.when(flag == "A", "no growth").alias("comments"),
        )

    @cached_property
    def icd_procedures(self) -> DataFrame:
        return self.lines.select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("icd_code"),
            F.when(F.col("l_linestatus") == "O", "9").otherwise("10").alias("icd_version"),
            F.date_add(F.to_date("o_orderdate"), (F.col("l_quantity") % 8).cast("int") - 1).alias("chartdate"),
        )

    @cached_property
    def d_icd(self) -> DataFrame:
        return self.table("part").select(
            F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("icd_code"),
            F.lit("9").alias("icd_version"),
            F.concat_ws(" ", "p_name", "p_type").alias("long_title"),
        )

    @cached_property
    def procedureevents(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("stay_id"),
            F.col("l_partkey").alias("itemid"),
            F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("starttime"),
            F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("value"),
            F.when(F.col("l_linenumber") < 5, "mL").alias("valueuom"),
            F.concat(F.lit("cat "), F.col("l_returnflag")).alias("ordercategoryname"),
            F.when(F.col("l_linestatus") == "O", "Task").otherwise("Drug").alias("ordercategorydescription"),
        )

    @cached_property
    def ed_lines(self) -> DataFrame:
        """Line items as rows of an emergency stay: medication, triage, diagnosis."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("stay_id"),
            F.col("l_shipdate").alias("charttime"),
            F.concat(F.lit("med "), F.col("l_partkey").cast("string")).alias("name"),
            F.when(F.col("l_returnflag") != "N", F.concat(F.lit("class "), F.col("l_returnflag"))).alias("etcdescription"),
            F.when(F.col("l_linenumber") < 6, F.concat(F.lit("med "), F.col("l_partkey").cast("string"))).alias("given"),
            F.concat(F.lit("dx "), (F.col("l_partkey") % 40).cast("string")).alias("icd_title"),
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
        )

    @cached_property
    def diagnoses(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
        return self.lines.join(p, "l_partkey", "left").select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_linenumber").cast("bigint").alias("seq_num"),
            F.when(F.col("l_tax") < 0.08, F.concat_ws(" ", "p_name", F.when(F.col("l_linestatus") == "O", F.upper("p_type")).otherwise(F.lower("p_type")))).alias("long_title"),
        )

    @cached_property
    def tracker(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("subject_id"),
            F.col("event_type").alias("script_name"),
            F.date_trunc("day", "ts").cast("timestamp_ntz").alias("processed_at"),
            F.when(F.col("value") >= 10, "success").otherwise("failed").alias("status"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("subject_id"), F.col("embedding").alias("vector"), "label")
