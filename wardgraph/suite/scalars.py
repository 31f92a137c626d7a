"""Scalar functions on whole tables: time, text, lists, maps and stored lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.functions import clinical, text, times
from wardgraph.operators.embedding import CHUNK_CHARS, CHUNK_WORDS, OVERLAP_CHARS, OVERLAP_WORDS, character_chunker
from wardgraph.suite import facts
from wardgraph.suite.registry import query
from wardgraph.suite.sql_views import VIEWS, floats, gap, period, ts
from wardgraph.suite.views import Views

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(LINE_KEY)


# --- time ------------------------------------------------------------------------


@query("t1_period_string", f"SELECT {KEYS}, {period('o_orderdate', 'l_shipdate')} AS period FROM lines")
def t1(v: Views) -> DataFrame:
    return v.lines.select(*LINE_KEY, times.period_string(F.col("o_orderdate"), F.col("l_shipdate")).alias("period"))


@query(
    "t2_gap_string",
    f"SELECT event_id, {gap('ts', 'next_ts')} AS gap FROM flow_events",
)
def t2(v: Views) -> DataFrame:
    return v.flow_events.select("event_id", times.gap_string(F.col("ts"), F.col("next_ts")).alias("gap"))


VIEWS["ts_texts"] = f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'not a time'
           WHEN 'A' THEN {ts('l_shipdate')} ELSE '' END AS written, l_returnflag, l_shipdate FROM lineitem"""


@query(
    "t3_parse_ts",
    f"SELECT {KEYS}, CASE l_returnflag WHEN 'A' THEN {ts('l_shipdate')} END AS parsed FROM ts_texts",
)
def t3(v: Views) -> DataFrame:
    flag = F.col("l_returnflag")
    texts = F.when(flag == "R", "not a time").when(flag == "A", times.format_ts(F.col("l_shipdate"))).otherwise("")
    return v.table("lineitem").select(*LINE_KEY, times.format_ts(times.parse_ts(texts)).alias("parsed"))


@query("t4_chartdate_key", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def t4(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.date_format(times.date_key(F.col("ts")), "yyyy-MM-dd").alias("day"))


@query(
    "t5_ordinal",
    """SELECT o_orderkey, o_orderkey || CASE WHEN o_orderkey % 100 IN (11, 12, 13) THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st'
              WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal FROM orders""",
)
def t5(v: Views) -> DataFrame:
    return v.table("orders").select("o_orderkey", times.ordinal(F.col("o_orderkey")).alias("ordinal"))


@query("t6_display_ts", "SELECT event_id, strftime(ts, '%B %d, %Y at %I:%M %p') AS shown FROM events")
def t6(v: Views) -> DataFrame:
    return v.table("events").select("event_id", times.display_ts(F.col("ts")).alias("shown"))


# --- keys and flags ----------------------------------------------------------------


@query(
    "p6_drg_key",
    """SELECT o_orderkey, o_orderkey || '_' || o_orderpriority || '_' || o_orderstatus AS drg_id,
              o_orderpriority || '_DRG' AS name FROM orders""",
)
def p6(v: Views) -> DataFrame:
    kind = F.col("o_orderpriority")
    return v.table("orders").select(
        "o_orderkey", clinical.drg_key(F.col("o_orderkey"), kind, F.col("o_orderstatus")).alias("drg_id"), clinical.drg_name(kind).alias("name")
    )


@query(
    "p22_ed_home_flag",
    """SELECT stay_id, coalesce(disposition IN ('HOME', 'Left without being seen'), false) AS home FROM edstays""",
)
def p22(v: Views) -> DataFrame:
    return v.edstays.select("stay_id", clinical.left_ed_for_home(F.col("disposition")).alias("home"))


# --- text --------------------------------------------------------------------------

NORMAL = "trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"


@query("p8_normalize_text", f"SELECT doc_id, {NORMAL.format(c='text')} AS text FROM documents")
def p8(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.normalize(F.col("text")).alias("text"))


VIEWS["complaints"] = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN NULL ELSE p_name || '; ' || upper(p_type) || ', pain' END AS current,
           CASE l_returnflag WHEN 'R' THEN CASE l_linestatus WHEN 'O' THEN lower(p_type) ELSE 'bad ' || p_name END
                WHEN 'A' THEN p_brand ELSE '  ' END AS new
    FROM lineitem JOIN part ON l_partkey = p_partkey"""


def complaints(v: Views) -> DataFrame:
    part = v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    current = F.when(n == 1, "").when(n == 2, F.lit(None)).otherwise(
        F.concat("p_name", F.lit("; "), F.upper("p_type"), F.lit(", pain"))
    )
    new = (
        F.when(flag == "R", F.when(F.col("l_linestatus") == "O", F.lower("p_type")).otherwise(F.concat(F.lit("bad "), "p_name")))
        .when(flag == "A", F.col("p_brand"))
        .otherwise("  ")
    )
    return v.table("lineitem").join(part, "l_partkey").select(*LINE_KEY, current.alias("current"), new.alias("new"))


OLD_N, NEW_N = NORMAL.format(c="current"), NORMAL.format(c="new")
KNOWN = f"""({NEW_N} = '' OR ({OLD_N} <> '' AND (contains({OLD_N}, {NEW_N}) OR len(list_filter(
        string_split_regex(coalesce(current, ''), '[,;]'), lambda p: {NORMAL.format(c='p')} <> ''
            AND (contains({NORMAL.format(c='p')}, {NEW_N}) OR contains({NEW_N}, {NORMAL.format(c='p')})))) > 0)))"""


@query(
    "p9_complaint_merge",
    f"""SELECT {KEYS}, CASE WHEN {KNOWN} THEN current WHEN trim(coalesce(current, '')) = '' THEN new
               ELSE current || ', ' || new END AS complaint FROM complaints""",
)
def p9(v: Views) -> DataFrame:
    return complaints(v).select(*LINE_KEY, text.merge_complaint(F.col("current"), F.col("new")).alias("complaint"))


@query(
    "p10_split_list",
    """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','),
              lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''), '|') AS parts FROM documents""",
)
def p10(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.array_join(text.split_list(F.col("text")), "|").alias("parts"))


VIEWS["allergy_texts"] = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN 'None' WHEN l_linenumber = 6 THEN NULL ELSE
           p_name || ', ' || upper(p_name) || ' and ' || p_type || CASE l_returnflag WHEN 'R' THEN '; NKDA|' || p_brand ELSE '' END END AS text
    FROM lineitem JOIN part ON l_partkey = p_partkey"""


def allergy_texts(v: Views) -> DataFrame:
    part = v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    n = F.col("l_linenumber")
    more = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("; NKDA|"), "p_brand")).otherwise("")
    value = F.when(n == 7, "None").when(n == 6, F.lit(None)).otherwise(
        F.concat("p_name", F.lit(", "), F.upper("p_name"), F.lit(" and "), "p_type", more)
    )
    return v.table("lineitem").join(part, "l_partkey").select(*LINE_KEY, value.alias("text"), "l_returnflag")


@query(
    "p11_allergy_split",
    f"""SELECT {', '.join('l.' + k for k in LINE_KEY)}, CASE WHEN l_linenumber >= 6 THEN '' ELSE
               concat_ws('|', p_name, p_type, CASE WHEN l_returnflag = 'R' THEN p_brand END) END AS allergies
        FROM lineitem l JOIN part ON l_partkey = p_partkey""",
)
def p11(v: Views) -> DataFrame:
    return allergy_texts(v).select(*LINE_KEY, F.array_join(text.allergies(F.col("text")), "|").alias("allergies"))


@query(
    "p12_vitals_map",
    f"""SELECT {KEYS}, 'BP=' || l_linenumber || '/' || l_suppkey || ';Heart_Rate=' || l_partkey || ';O2_Sat=' || l_orderkey AS vitals
        FROM lineitem""",
)
def p12(v: Views) -> DataFrame:
    t = lambda c: F.col(c).cast("string")
    said = F.concat(
        F.lit("Heart Rate: "), t("l_suppkey"), F.lit(", junk, O2/Sat: "), t("l_orderkey"), F.lit(" ,BP: "), t("l_linenumber"),
        F.lit("/"), t("l_suppkey"), F.lit(", Heart Rate :"), t("l_partkey"),
    )
    entries = F.array_sort(F.map_entries(text.vitals_map(said)))
    return v.table("lineitem").select(
        *LINE_KEY, F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("vitals")
    )


@query(
    "p13_clean_text",
    """SELECT doc_id, trim(regexp_replace(replace(replace(text, 'a', '___'), '___', ''), '\\s+', ' ', 'g')) AS text FROM documents""",
)
def p13(v: Views) -> DataFrame:
    marked = F.replace(F.col("text"), F.lit("a"), F.lit("___"))
    return v.table("documents").select("doc_id", text.clean(marked).alias("text"))


STOP = ", ".join("'" + w + "'" for w in text.STOP_WORDS if "'" not in w)


@query(
    "p15_stopword_removal",
    f"""SELECT doc_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(
               regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w) NOT IN ({STOP})), ''),
               '\\s*([|:])\\s*', ' \\1 ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents""",
)
def p15(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.remove_stop_words(F.col("text")).alias("text"))


@query(
    "p16_dx_text",
    """WITH named AS (SELECT subject_id, long_title AS title, hadm_id, seq_num FROM diagnoses WHERE trim(long_title) <> ''),
       firsts AS (SELECT * FROM named
            QUALIFY row_number() OVER (PARTITION BY subject_id, lower(title) ORDER BY hadm_id, seq_num, title) = 1)
       SELECT subject_id, string_agg(title, ' | ' ORDER BY hadm_id, seq_num, title) AS text FROM firsts GROUP BY subject_id""",
)
def p16(v: Views) -> DataFrame:
    return all_diagnoses(v).select("subject_id", text.join_diagnoses(F.col("all_diagnoses")).alias("text"))


def all_diagnoses(v: Views) -> DataFrame:
    from wardgraph.operators.diagnoses import patient_union

    return patient_union(v.diagnoses.withColumnRenamed("long_title", "title"), ["hadm_id", "seq_num"])


STEP = CHUNK_WORDS - OVERLAP_WORDS


@query(
    "p18_text_chunk",
    f"""WITH worded AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(CASE WHEN len(words) <= {CHUNK_WORDS} THEN [0]
             ELSE range(0, CAST(ceil((len(words) - {CHUNK_WORDS}) / {STEP}.0) AS BIGINT) + 1) END) AS n FROM worded)
        SELECT doc_id, CAST(n AS BIGINT) AS chunk_no, array_to_string(words[n * {STEP} + 1 : n * {STEP} + {CHUNK_WORDS}], ' ') AS chunk FROM starts""",
)
def p18(v: Views) -> DataFrame:
    chunks = text.chunk_by_words(F.col("text"), CHUNK_WORDS, OVERLAP_WORDS)
    return v.table("documents").select("doc_id", F.posexplode(chunks).alias("chunk_no", "chunk")).withColumn(
        "chunk_no", F.col("chunk_no").cast("bigint")
    )


@query(
    "p18_text_chunk_characters",
    f"""WITH RECURSIVE ends AS (
            SELECT doc_id, 0 AS chunk_no, 0::BIGINT AS s FROM documents
            UNION ALL
            SELECT doc_id, chunk_no + 1, greatest(s + CASE WHEN i > 0 THEN i + 1 ELSE {CHUNK_CHARS} END - {OVERLAP_CHARS}, s + 1)
            FROM (SELECT e.*, length(d.text) AS n, length(regexp_extract(substr(d.text, s + 1, {CHUNK_CHARS}), '(?s)^(.*)[.|]', 1)) AS i
                  FROM ends e JOIN documents d ON e.doc_id = d.doc_id) WHERE s + {CHUNK_CHARS} < n)
        SELECT doc_id, chunk_no, CASE WHEN s + {CHUNK_CHARS} >= length(text) THEN substr(text, s + 1)
               ELSE substr(text, s + 1, CASE WHEN i > 0 THEN i + 1 ELSE {CHUNK_CHARS} END) END AS chunk
        FROM (SELECT e.*, d.text, length(regexp_extract(substr(d.text, s + 1, {CHUNK_CHARS}), '(?s)^(.*)[.|]', 1)) AS i
              FROM ends e JOIN documents d ON e.doc_id = d.doc_id)""",
)
def p18_characters(v: Views) -> DataFrame:
    """Chunks that end at sentence marks; where one ends decides where the next begins."""
    return v.table("documents").select("doc_id", F.posexplode(character_chunker()(F.col("text"))).alias("chunk_no", "chunk"))


# --- stored lines taken apart -------------------------------------------------------


@query(
    "p14_lab_string_parse",
    f"""SELECT labevent_id, label AS test_name,
               coalesce({floats('valuenum')} || coalesce(valueuom, ''), 'N/A') AS value,
               coalesce({floats('ref_range_lower')} || '-' || {floats('ref_range_upper')}, '') AS ref_range,
               flag IS NOT NULL AS is_abnormal, coalesce(fluid, '') AS specimen, coalesce(category, '') AS category
        FROM labevents JOIN d_items USING (itemid)""",
)
def p14(v: Views) -> DataFrame:
    lines = facts.lab_facts(v).where(F.col("label").isNotNull()).select("labevent_id", facts.lab_text().alias("line"))
    return lines.select("labevent_id", text.parse_lab(F.col("line")).alias("p")).select("labevent_id", "p.*")


@query(
    "a19_lab_category_group",
    f"""WITH {facts.LAB_BUNDLES}, listed AS (SELECT p.event_id, p.charttime, p.labevent_id, coalesce(nullif(i.category, ''), 'Other') AS category,
             i.label FROM placed p JOIN d_items i USING (itemid))
        SELECT event_id, {ts('charttime')} AS charttime, category, count(*) AS tests,
               string_agg(label, '; ' ORDER BY label) AS test_names FROM listed GROUP BY event_id, charttime, category""",
)
def a19(v: Views) -> DataFrame:
    """Lines of stored bundles regrouped by the category they name."""
    lines = facts.lab_bundles(v).select("event_id", "charttime", F.explode("lab_results").alias("line"))
    parsed = lines.withColumn("p", text.parse_lab(F.col("line"))).where(F.col("p").isNotNull())
    category = F.coalesce(F.nullif(F.col("p.category"), F.lit("")), F.lit("Other"))
    return parsed.groupBy("event_id", times.format_ts(F.col("charttime")).alias("charttime"), category.alias("category")).agg(
        F.count(F.lit(1)).alias("tests"), F.array_join(F.array_sort(F.collect_list("p.test_name")), "; ").alias("test_names")
    )


MICRO_LINES = f"""micro_lines AS (SELECT s.event_id, r.*, {facts.MICRO_TEXT} AS line
        FROM microbiology r JOIN admission_windows s ON {facts.RX_IN_STAY.format(t='charttime')} WHERE micro_specimen_id IS NOT NULL),
    found AS (SELECT event_id, charttime, CASE WHEN contains(line, '→') THEN test_name || ': ' || spec_type_desc ELSE 'Other' END AS grp,
        CASE WHEN contains(line, '→') THEN split_part(line, ' → ', 2) ELSE line END AS finding, spec_type_desc, org_name,
        ab_name, dilution_value, interpretation FROM micro_lines)"""


def micro_findings(v: Views) -> DataFrame:
    # Lines of one stay and moment, of all its specimens.
    lines = facts.micro_bundles(v).select("event_id", "charttime", F.explode("micro_results").alias("line"))
    return lines.select("event_id", "charttime", text.parse_micro(F.col("line")).alias("p")).where(
        F.col("p.grp").isNotNull()
    ).select("event_id", "charttime", "p.grp", "p.finding")


@query(
    "a20_micro_group",
    f"""WITH {MICRO_LINES} SELECT event_id, {ts('charttime')} AS charttime, grp, count(*) AS n,
               string_agg(finding, '; ' ORDER BY finding) AS findings FROM found GROUP BY event_id, charttime, grp""",
)
def a20(v: Views) -> DataFrame:
    return micro_findings(v).groupBy("event_id", times.format_ts(F.col("charttime")).alias("charttime"), "grp").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("finding")), "; ").alias("findings")
    )


@query(
    "a21_antibiogram",
    f"""WITH {MICRO_LINES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id, grp ORDER BY finding) AS place,
             count(*) OVER (PARTITION BY event_id, grp) AS n FROM found),
        shown AS (SELECT event_id, grp, arg_min(split_part(finding, ' | ', 1), place) AS organism FROM ranked GROUP BY event_id, grp
             HAVING max(n) > 3 AND bool_and(contains(finding, '|') OR place > 3))
        SELECT r.event_id, r.grp, s.organism, r.ab_name AS antibiotic,
               {floats('r.dilution_value')} || '(' || r.interpretation || ')' AS sensitivity
        FROM ranked r JOIN shown s USING (event_id, grp) WHERE contains(r.finding, '|')""",
)
def a21(v: Views) -> DataFrame:
    """Sensitivity tables of groups that look like one, per stay."""
    return facts.bundles.antibiogram(micro_findings(v), ["event_id", "grp"])


# --- defaults and blanks -------------------------------------------------------------


@query(
    "f9_null_to_default",
    """SELECT transfer_id, coalesce(careunit, 'Unknown') AS careunit, coalesce(CAST(hadm_id AS VARCHAR), '') AS hadm_id FROM transfers""",
)
def f9(v: Views) -> DataFrame:
    return v.transfers.select(
        "transfer_id", clinical.or_default(F.col("careunit"), clinical.UNKNOWN).alias("careunit"),
        clinical.or_default(F.col("hadm_id").cast("string"), "").alias("hadm_id"),
    )


@query(
    "f10_all_null_skip",
    """SELECT l_orderkey, l_partkey, l_suppkey FROM prescriptions WHERE drug IS NOT NULL OR dose_val_rx IS NOT NULL OR route IS NOT NULL""",
)
def f10(v: Views) -> DataFrame:
    known = F.coalesce("drug", "dose_val_rx", "route").isNotNull()
    return v.prescriptions.where(known).select("l_orderkey", "l_partkey", "l_suppkey")
