"""The mapping of ``views`` in SQL, for the checks."""

from __future__ import annotations

import re

VIEWS = {
    "patients": """
        SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               20 + c_custkey % 60 AS anchor_age, CAST(2100 + c_nationkey AS BIGINT) AS anchor_year,
               c_mktsegment AS anchor_year_group,
               CASE WHEN c_acctbal < 0 THEN '2150-01-01' END AS dod
        FROM customer""",
    "admissions": """
        SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate AS admittime,
               o_orderdate + to_days(CAST(o_orderkey % 10 AS INTEGER)) AS dischtime,
               o_orderpriority AS admission_type, o_orderstatus AS discharge_location,
               CASE WHEN o_orderstatus = 'P' THEN '  '
                    WHEN o_orderpriority <> '2-HIGH' THEN ' P' || (o_custkey % 97) END AS admit_provider_id
        FROM orders""",
    "flow_events": """
        SELECT event_id, ts, user_id, event_type, value, k,
               coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER b, 0)::BIGINT AS n_before,
               last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) OVER b AS prev_type,
               first_value(CASE WHEN event_type <> 'click' THEN ts END IGNORE NULLS) OVER a AS next_ts
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
    "transfers": """
        SELECT event_id AS transfer_id, user_id AS subject_id,
               CASE WHEN event_type = 'error' AND k < 20 THEN NULL ELSE user_id * 100000 + n_before END AS hadm_id,
               CASE event_type WHEN 'signup' THEN 'admit' WHEN 'view' THEN 'transfer'
                    WHEN 'purchase' THEN 'discharge' ELSE 'ed' END AS eventtype,
               CASE WHEN k < 95 THEN 'unit_' || (k % 3) END AS careunit,
               ts AS intime, CASE WHEN event_type <> 'purchase' THEN next_ts END AS outtime, value, k
        FROM flow_events WHERE event_type <> 'click'""",
    "flow_admissions": """
        SELECT subject_id, hadm_id, min(CASE WHEN eventtype = 'admit' THEN intime END) AS admittime,
               max(CASE WHEN eventtype = 'discharge' THEN intime END) AS dischtime
        FROM transfers WHERE hadm_id IS NOT NULL GROUP BY subject_id, hadm_id""",
    "services": """
        SELECT subject_id, hadm_id, intime AS transfertime, 'S' || (k % 4) AS curr_service
        FROM transfers WHERE eventtype IN ('admit', 'transfer') AND value > 10
        UNION ALL
        SELECT subject_id, hadm_id, intime, 'R9' FROM transfers
        WHERE eventtype IN ('admit', 'transfer') AND value > 50""",
    "edstays": """
        SELECT subject_id, transfer_id AS stay_id, hadm_id, intime, outtime,
               CASE WHEN k < 25 THEN 'HOME' WHEN k < 50 THEN 'ADMITTED'
                    WHEN k < 60 THEN 'Left without being seen' END AS disposition,
               CASE WHEN k % 2 = 0 THEN 'AMBULANCE' ELSE 'WALK IN' END AS arrival_transport
        FROM transfers WHERE eventtype = 'ed' AND value > 15""",
    "icustays": """
        SELECT subject_id, hadm_id, transfer_id AS stay_id, careunit AS first_careunit,
               'unit_' || (k % 2) AS last_careunit, intime, outtime, value AS los
        FROM transfers WHERE eventtype IN ('admit', 'transfer') AND careunit = 'unit_0'""",
    "served": """
        SELECT t.*, s.service_given FROM transfers t LEFT JOIN (
            SELECT subject_id, hadm_id, transfertime, max(curr_service) AS service_given
            FROM services GROUP BY ALL) s
        ON t.subject_id = s.subject_id AND t.hadm_id IS NOT DISTINCT FROM s.hadm_id
           AND t.intime = s.transfertime""",
    "flow_rows": """
        SELECT *, CASE WHEN eventtype IN ('admit', 'transfer') AND p_type IN ('admit', 'transfer')
                            AND unit = p_unit AND p_out = intime THEN 0 ELSE 1 END AS opens
        FROM (SELECT *, lag(eventtype) OVER w AS p_type, lag(unit) OVER w AS p_unit, lag(outtime) OVER w AS p_out
              FROM (SELECT *, coalesce(careunit, 'Unknown') AS unit FROM served WHERE hadm_id IS NOT NULL)
              WINDOW w AS (PARTITION BY subject_id, hadm_id ORDER BY intime, transfer_id))""",
    "stays": """
        SELECT subject_id, hadm_id, arg_min(transfer_id, transfer_id)::VARCHAR AS event_id,
               arg_min(eventtype, transfer_id) AS eventtype, any_value(unit) AS careunit,
               arg_min({'v': service_given}, transfer_id).v AS service_given, min(intime) AS intime,
               arg_max({'v': outtime}, transfer_id).v AS outtime, count(*) AS merged_rows,
               CASE arg_min(eventtype, transfer_id) WHEN 'ed' THEN 'EmergencyDepartment'
                    WHEN 'discharge' THEN 'Discharge' ELSE 'UnitAdmission' END AS label
        FROM (SELECT *, sum(opens) OVER (PARTITION BY subject_id, hadm_id ORDER BY intime, transfer_id
                                         ROWS UNBOUNDED PRECEDING) AS run FROM flow_rows)
        GROUP BY subject_id, hadm_id, run""",
    "stay_windows": """
        SELECT s.subject_id, s.hadm_id, s.event_id,
               CASE WHEN i.stay_id IS NOT NULL AND s.label = 'UnitAdmission' THEN 'ICUStay' ELSE s.label END AS label,
               s.intime, s.outtime
        FROM stays s LEFT JOIN icustays i ON s.event_id = CAST(i.stay_id AS VARCHAR)
        UNION ALL
        SELECT subject_id, hadm_id, CAST(transfer_id AS VARCHAR), 'EmergencyDepartment', intime, outtime
        FROM transfers WHERE hadm_id IS NULL""",
    "d_items": """
        SELECT p_partkey AS itemid, p_name AS label, p_brand AS fluid, p_type AS category, 'u' || p_size AS unitname,
               CASE WHEN p_type = 'ECONOMY' THEN 'Text' ELSE 'Numeric' END AS param_type,
               CAST(p_size AS DOUBLE) AS lownormalvalue, p_size * 10.0::DOUBLE AS highnormalvalue
        FROM part""",
    "labevents": """
        SELECT event_id * 3 + j AS labevent_id, user_id AS subject_id, item AS itemid,
               CASE WHEN prev_type IS NOT NULL THEN user_id * 100000 + n_before
                    - CASE WHEN prev_type = 'purchase' THEN 1 ELSE 0 END END AS hadm_id,
               date_trunc('second', ts) AS charttime, CASE WHEN item >= 5 THEN v END AS valuenum,
               CASE WHEN item % 2 = 0 THEN 'mg' END AS valueuom,
               CASE WHEN item <= 90 THEN item * 0.25::DOUBLE END AS ref_range_lower,
               item * 0.75::DOUBLE + 5 AS ref_range_upper, CASE WHEN v > 40 THEN 'abnormal' END AS flag
        FROM (SELECT *, (k + j) % 100 AS item, value + j * 0.5::DOUBLE AS v
              FROM flow_events, (SELECT unnest([0, 1, 2])::BIGINT AS j) WHERE event_type = 'click')""",
    "lines": """
        SELECT l.*, o.o_custkey, o.o_orderdate, o.o_orderstatus, o.o_orderpriority
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "admission_windows": """
        SELECT o_custkey AS subject_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS hadm_id,
               CAST(o_orderkey AS VARCHAR) AS event_id, 'UnitAdmission' AS label, o_orderdate AS intime,
               CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate + to_days(CAST(o_orderkey % 10 AS INTEGER)) END AS outtime
        FROM orders""",
    "prescriptions": """
        SELECT o_custkey AS subject_id,
               CASE WHEN o_orderstatus <> 'P' OR l_returnflag = 'R' THEN l_orderkey END AS hadm_id,
               CASE WHEN l_linestatus = 'O' OR l_returnflag <> 'N' THEN l_orderkey || '-' || l_linenumber END AS poe_id,
               o_orderdate + to_days(CAST(l_quantity % 8 AS INTEGER)) AS starttime,
               CASE WHEN l_partkey % 50 <> 0 THEN 'drug ' || l_partkey END AS drug,
               CASE WHEN l_linenumber < 6 THEN CAST(l_linenumber AS VARCHAR) END AS dose_val_rx,
               CASE WHEN l_linenumber < 7 THEN 'mg' END AS dose_unit_rx,
               CASE WHEN l_returnflag <> 'A' THEN 'route ' || l_returnflag END AS route,
               round(l_discount * 100) AS doses_per_24_hrs,
               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
        FROM lines""",
    "microbiology": """
        SELECT o_custkey AS subject_id, CASE WHEN o_orderstatus <> 'P' THEN l_orderkey END AS hadm_id,
               CASE WHEN l_returnflag <> 'N' OR l_linestatus <> 'O' THEN l_orderkey * 10 + l_linenumber % 2 END AS micro_specimen_id,
               o_orderdate + to_days(CAST(l_quantity % 8 AS INTEGER)) AS charttime,
               'spec ' || (l_linenumber % 2) AS spec_type_desc, 'test ' || l_linestatus AS test_name,
               CASE WHEN l_returnflag = 'R' THEN 'ORG ' || l_linenumber END AS org_name,
               CASE WHEN l_linenumber < 6 THEN 'ab ' || (l_partkey % 7) END AS ab_name,
               CASE WHEN l_tax > 0.01 THEN l_tax END AS dilution_value, l_linestatus AS interpretation,
               CASE WHEN l_returnflag = 'A' THEN 'no growth' END AS comments
        FROM lines""",
    "icd_procedures": """
        SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS icd_code,
               CASE WHEN l_linestatus = 'O' THEN '9' ELSE '10' END AS icd_version,
               CAST(CAST(o_orderdate AS DATE) + CAST(l_quantity % 8 AS INTEGER) - 1 AS DATE) AS chartdate
        FROM lines""",
    "d_icd": """
        SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS icd_code, '9' AS icd_version,
               p_name || ' ' || p_type AS long_title
        FROM part""",
    "procedureevents": """
        SELECT l_orderkey AS stay_id, l_partkey AS itemid, date_trunc('year', l_shipdate)::TIMESTAMP AS starttime,
               CASE WHEN l_linenumber < 7 THEN l_quantity END AS value,
               CASE WHEN l_linenumber < 5 THEN 'mL' END AS valueuom, 'cat ' || l_returnflag AS ordercategoryname,
               CASE WHEN l_linestatus = 'O' THEN 'Task' ELSE 'Drug' END AS ordercategorydescription
        FROM lineitem""",
    "ed_lines": """
        SELECT l_orderkey AS stay_id, l_shipdate AS charttime, 'med ' || l_partkey AS name,
               CASE WHEN l_returnflag <> 'N' THEN 'class ' || l_returnflag END AS etcdescription,
               CASE WHEN l_linenumber < 6 THEN 'med ' || l_partkey END AS given,
               'dx ' || (l_partkey % 40) AS icd_title, l_linenumber, l_partkey, l_suppkey
        FROM lineitem""",
    "diagnoses": """
        SELECT l.o_custkey AS subject_id, l.l_orderkey AS hadm_id, CAST(l.l_linenumber AS BIGINT) AS seq_num,
               CASE WHEN l.l_tax < 0.08 THEN p.p_name || ' ' || CASE WHEN l.l_linestatus = 'O' THEN upper(p.p_type)
                    ELSE lower(p.p_type) END END AS long_title
        FROM lines l LEFT JOIN part p ON l.l_partkey = p.p_partkey""",
    "tracker": """
        SELECT user_id AS subject_id, event_type AS script_name, date_trunc('day', ts)::TIMESTAMP AS processed_at,
               CASE WHEN value >= 10 THEN 'success' ELSE 'failed' END AS status, event_id AS seq
        FROM events""",
    "vectors": "SELECT vec_id AS subject_id, embedding AS vector, label FROM embeddings",
}


def _needed(sql: str, found: dict[str, None]) -> None:
    for name, body in VIEWS.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(body, found)
            found[name] = None


def with_views(sql: str) -> str:
    """The statement with the views it names put in front as common table expressions."""
    body = sql.strip()
    found: dict[str, None] = {}
    _needed(body, found)
    own, recursive = "", ""
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if match:
        recursive = match.group(1) or ""
        own, body = "own", body[match.end() :]
    parts = [f"{name} AS MATERIALIZED ({VIEWS[name].strip()})" for name in found]
    if not parts:
        return f"WITH {recursive}{body}" if own else body
    head = f"WITH {recursive}" + ",\n".join(parts)
    return head + (",\n" if own else "\n") + body


# --- expressions the checks share --------------------------------------------


def ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def floats(c: str) -> str:
    plain = f"regexp_replace(CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR), '0+$', '')"
    return f"regexp_replace({plain}, '\\.$', '.0')"


def shorts(c: str) -> str:
    plain = f"regexp_replace(CAST(CAST({c} AS DECIMAL(38,6)) AS VARCHAR), '0+$', '')"
    return f"regexp_replace({plain}, '\\.$', '')"


def seconds(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 1000000.0) AS BIGINT)"


def period(a: str, b: str) -> str:
    s = seconds(a, b)
    d = f"CAST(floor({s} / 86400.0) AS BIGINT)"
    r = f"({s} - {d} * 86400)"
    return f"({d} || ' days ' || ({r} // 3600) || ' hours ' || (({r} % 3600) // 60) || ' minutes')"


def gap(a: str, b: str) -> str:
    s = seconds(a, b)
    d = f"CAST(floor({s} / 86400.0) AS BIGINT)"
    r = f"({s} - {d} * 86400)"

    def part(n: str, unit: str) -> str:
        return f"CASE WHEN {n} = 1 THEN '1 {unit}' WHEN {n} > 0 THEN {n} || ' {unit}s' END"

    text = f"concat_ws(', ', {part(d, 'day')}, {part(f'({r} // 3600)', 'hour')}, {part(f'(({r} % 3600) // 60)', 'minute')})"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL "
        f"ELSE coalesce(nullif({text}, ''), 'less than a minute') END"
    )
