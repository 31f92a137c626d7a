"""Texts, vectors, similarity, comparison and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.functions.vectors import mean_vector
from wardgraph.operators import comparison, embedding, similarity, vector_index
from wardgraph.session import shared_dir, written
from wardgraph.suite import facts, graph
from wardgraph.suite.registry import query
from wardgraph.suite.scalars import all_diagnoses
from wardgraph.suite.sql_views import VIEWS, floats
from wardgraph.suite.views import Views

# The patient every search starts from, and the two that are compared.
SUBJECT = 7
PAIR = (11, 12)

COS = "list_cosine_similarity(CAST(v.vector AS DOUBLE[]), CAST(r.vector AS DOUBLE[]))"
SCORES = f"""scores AS (SELECT v.subject_id, {COS} AS score FROM vectors v, (SELECT vector FROM vectors WHERE subject_id = {SUBJECT}) r)"""


def _rounded(c: str = "score"):
    return F.round(c, 6).alias(c)


@query(
    "m2_cosine",
    f"WITH {SCORES} SELECT subject_id, round(score, 6) AS score FROM scores",
)
def m2(v: Views) -> DataFrame:
    return similarity.scored(v.vectors, similarity.vector_of(v.vectors, SUBJECT)).select("subject_id", _rounded())


@query(
    "jn17_self_cross_similarity",
    f"WITH {SCORES} SELECT subject_id, round(score, 6) AS score FROM scores WHERE subject_id <> {SUBJECT}",
)
def jn17(v: Views) -> DataFrame:
    return similarity.others(v.vectors, SUBJECT).select("subject_id", _rounded())


@query(
    "v3_similar_patients",
    f"""WITH {SCORES} SELECT subject_id, round(score, 6) AS score FROM scores WHERE subject_id <> {SUBJECT} AND round(score, 12) < 1
        ORDER BY scores.score DESC, subject_id LIMIT 20""",
)
def v3(v: Views) -> DataFrame:
    return similarity.patients(v.vectors, SUBJECT, 20).select("subject_id", _rounded())


@query(
    "o2_topk_similarity",
    f"""WITH {SCORES} SELECT subject_id, round(score, 6) AS score FROM scores WHERE subject_id <> {SUBJECT} AND round(score, 12) < 1
        ORDER BY scores.score DESC, subject_id LIMIT 50""",
)
def o2(v: Views) -> DataFrame:
    return similarity.patients(v.vectors, SUBJECT, 50).select("subject_id", _rounded())


@query(
    "v4_vector_index_search",
    f"""WITH {SCORES} SELECT subject_id, round(score, 6) AS score FROM (
            SELECT * FROM scores ORDER BY score DESC, subject_id LIMIT 20) WHERE subject_id <> {SUBJECT}""",
)
def v4(v: Views) -> DataFrame:
    return similarity.by_index(v.vectors, SUBJECT, 20).select("subject_id", _rounded())


_indexes: dict[tuple[str, str], vector_index.Index] = {}


def index(v: Views) -> vector_index.Index:
    """The stored index of all vectors, built on first use in a session."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _indexes:
        _indexes[key] = vector_index.build(v.vectors, f"{shared_dir(v.spark)}/index-{uuid.uuid4().hex}")
    return _indexes[key]


@query("v4_approximate_search")
def v4_approximate(v: Views) -> DataFrame:
    """Search in the nearest cells of the stored index; which cells there are depends on the learning, so there is no SQL."""
    return vector_index.nearest_patients(index(v), SUBJECT, 20).select("subject_id", _rounded())


@query(
    "v4_stored_index_search",
    f"""WITH {SCORES} SELECT subject_id, round(score, 6) AS score FROM scores WHERE subject_id <> {SUBJECT} AND round(score, 12) < 1
        ORDER BY scores.score DESC, subject_id LIMIT 20""",
)
def v4_stored(v: Views) -> DataFrame:
    """With all cells probed the stored index gives what the exact search gives."""
    return vector_index.nearest_patients(index(v), SUBJECT, 20, probes=vector_index.CELLS).select("subject_id", _rounded())


# Recall is measured on at most so many patients, those of least hash.
ASKED = 50


@query(
    "v4_index_recall",
    f"""WITH n AS (SELECT least(count(*), {ASKED}) AS queries, (SELECT count(*) FROM vectors) AS stored FROM vectors WHERE subject_id % 50 = 0)
        SELECT probes, CAST(queries AS BIGINT) AS queries, CAST(queries * least(20, stored - 1) AS BIGINT) AS expected, goal, TRUE AS reached
        FROM n, (VALUES ({vector_index.PROBES}, 0.9::DOUBLE), ({vector_index.CELLS}, 1.0::DOUBLE)) AS p(probes, goal)""",
)
def v4_recall(v: Views) -> DataFrame:
    """Recall at 20 against the exact search, by the number of cells probed: 0.9 with the default, 1 with all."""
    stored = index(v)
    asked = vector_index.asked_for(stored, F.col("subject_id") % 50 == 0).orderBy(F.xxhash64("query"), "query").limit(ASKED)
    asked = written(asked, "asked")
    # The exact answer: a bounded set of vectors beside all.
    exact = written(vector_index.exact(v.vectors, asked, 20).select("query", "subject_id"), "exact")
    out = None
    for probes, goal in ((vector_index.PROBES, 0.9), (vector_index.CELLS, 1.0)):
        one = vector_index.recall(vector_index.search(stored, asked, 20, probes), exact)
        one = one.crossJoin(F.broadcast(asked.agg(F.count("*").alias("queries")))).select(
            F.lit(probes).alias("probes"), "queries", "expected", F.lit(goal).alias("goal"), (F.col("recall") >= goal).alias("reached")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "a18_score_stats",
    f"""WITH {SCORES} SELECT count(*) AS found, round(max(score), 6) AS best, round(min(score), 6) AS worst FROM (
            SELECT * FROM scores WHERE subject_id <> {SUBJECT} AND round(score, 12) < 1 ORDER BY score DESC, subject_id LIMIT 20)""",
)
def a18(v: Views) -> DataFrame:
    return similarity.score_stats(similarity.patients(v.vectors, SUBJECT, 20)).select("found", _rounded("best"), _rounded("worst"))


@query(
    "a16_vector_mean",
    """WITH places AS (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vectors),
       means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM places GROUP BY label, i)
       SELECT label, CAST(i AS BIGINT) AS place, round(m, 6) AS mean FROM means""",
)
def a16(v: Views) -> DataFrame:
    """Mean of the vectors of each class, one row per place."""
    means = v.vectors.groupBy("label").agg(mean_vector(F.col("vector")).alias("m"))
    return means.select("label", F.posexplode("m").alias("i", "x")).select(
        "label", (F.col("i") + 1).cast("bigint").alias("place"), F.round("x", 6).alias("mean")
    )


# --- texts and embeddings -------------------------------------------------------------

DIM = 64


def hashed(texts: str, key: str, dim: int = DIM) -> str:
    """SQL for the default embedder over a relation with ``key`` and ``text``."""
    size, step = embedding.CHUNK_WORDS, embedding.CHUNK_WORDS - embedding.OVERLAP_WORDS
    return f"""worded AS (SELECT {key}, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS words FROM {texts} WHERE trim(text) <> ''),
    starts AS (SELECT {key}, words, unnest(range(0, CAST(greatest(0, ceil((len(words) - {size}) / {step}.0)) AS BIGINT) + 1)) AS n FROM worded),
    tokens AS (SELECT {key}, n, lower(unnest(words[n * {step} + 1 : n * {step} + {size}])) AS w FROM starts),
    slots AS (SELECT {key}, n, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim} AS i, count(*) AS c FROM tokens GROUP BY ALL),
    sized AS (SELECT {key}, n, i, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key}, n)) AS FLOAT) AS x FROM slots),
    chunked AS (SELECT {key}, count(DISTINCT n) AS chunks FROM starts GROUP BY {key}),
    vectored AS (SELECT s.{key}, i, CAST(sum(CAST(x AS DOUBLE)) / any_value(chunks) AS FLOAT) AS x, any_value(chunks) AS chunks
                 FROM sized s JOIN chunked USING ({key}) GROUP BY s.{key}, i)"""


VIEWS["dx_texts"] = """
    WITH named AS (SELECT subject_id, long_title AS title, hadm_id, seq_num FROM diagnoses WHERE trim(long_title) <> ''),
    firsts AS (SELECT * FROM named
        QUALIFY row_number() OVER (PARTITION BY subject_id, lower(title) ORDER BY hadm_id, seq_num, title) = 1)
    SELECT subject_id, string_agg(title, ' | ' ORDER BY hadm_id, seq_num, title) AS text FROM firsts GROUP BY subject_id"""


def dx_texts(v: Views) -> DataFrame:
    """A patient's diagnoses as one text; the embedder and the search read what is written once."""
    return v.once("dx_texts", lambda: all_diagnoses(v).select("subject_id", F.array_join("all_diagnoses", " | ").alias("text")))


def dx_vectors(v: Views) -> DataFrame:
    made = embedding.embed(dx_texts(v), "subject_id", "text", embedding.hashing_embedder(DIM))
    return v.once("dx_vectors", lambda: made)


def _places(vectors: DataFrame, key: str) -> DataFrame:
    """Non-zero places of the vectors, one row each."""
    places = vectors.select(key, "chunks", F.posexplode("vector").alias("i", "x"))
    return places.where(F.col("x") != 0).select(
        key, "chunks", F.col("i").cast("bigint").alias("place"), F.round(F.col("x").cast("double"), 5).alias("x")
    )


@query(
    "v2_diagnosis_embedding",
    f"""WITH {hashed('dx_texts', 'subject_id')} SELECT subject_id, chunks, i AS place, round(CAST(x AS DOUBLE), 5) AS x FROM vectored""",
)
def v2(v: Views) -> DataFrame:
    return _places(dx_vectors(v), "subject_id")


@query(
    "v1_text_embedding",
    f"""WITH {hashed('documents', 'doc_id')} SELECT doc_id, chunks, i AS place, round(CAST(x AS DOUBLE), 5) AS x FROM vectored""",
)
def v1_documents(v: Views) -> DataFrame:
    """The embedding step on long texts: chunks, vectors of chunks, their mean."""
    docs = v.table("documents").select("doc_id", "text")
    return _places(embedding.embed(docs, "doc_id", "text", embedding.hashing_embedder(DIM)), "doc_id")


SEARCH = "the red widget, small ring; blue bolt"


@query(
    "v5_patients_by_diagnosis",
    f"""WITH {hashed('dx_texts', 'subject_id')},
        asked AS (SELECT i, CAST(c / sqrt(sum(c * c) OVER ()) AS FLOAT) AS x FROM (SELECT
            CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIM} AS i, count(*) AS c
            FROM (SELECT unnest(string_split('red widget | small ring | blue bolt', ' ')) AS w) GROUP BY 1)),
        dots AS (SELECT v.subject_id, sum(CAST(v.x AS DOUBLE) * CAST(a.x AS DOUBLE)) AS d FROM vectored v JOIN asked a USING (i) GROUP BY 1),
        norms AS (SELECT subject_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM vectored GROUP BY 1),
        scores AS (SELECT subject_id, coalesce(d, 0) / (n * (SELECT sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) FROM asked)) AS score
                   FROM norms LEFT JOIN dots USING (subject_id))
        SELECT subject_id, round(score, 5) AS score, text AS all_diagnoses FROM scores JOIN dx_texts USING (subject_id)
        WHERE round(score, 12) < 1 ORDER BY scores.score DESC, subject_id LIMIT 20""",
)
def v5(v: Views) -> DataFrame:
    """Patients nearest to a diagnosis in free text."""
    asked = v.spark.createDataFrame([(SEARCH,)], "text string")
    # Only the texts of those found are looked up.
    best = similarity.by_diagnosis(dx_vectors(v).where(F.col("subject_id").isNotNull()), asked, embedding.hashing_embedder(DIM), 20)
    told = dx_texts(v).select("subject_id", F.col("text").alias("all_diagnoses")).join(F.broadcast(best), "subject_id")
    return told.orderBy(F.desc("score"), "subject_id").select("subject_id", F.round("score", 5).alias("score"), "all_diagnoses")


def text_items(v: Views) -> DataFrame:
    """Different items per patient and category from the built graph."""
    return v.once("text_items", lambda: embedding.distinct_items(graph.built(v).frames))


ITEMS = f"""items AS (
    SELECT DISTINCT subject_id, 18 AS rank, 'Lab Events: ' AS heading, text AS item FROM (
        SELECT l.*, i.label, i.fluid, i.category, {facts.LAB_TEXT.replace('label', 'i.label')} AS text
        FROM labevents l JOIN d_items i USING (itemid)) l SEMI JOIN g_labs g ON g.labevent_id = l.labevent_id
    UNION ALL SELECT DISTINCT subject_id, 27, 'DRG Codes: ', 'drg_type: ' || CASE WHEN hadm_id % 2 = 0 THEN 'HCFA' ELSE 'APR' END
        || ', drg_code: ' || (hadm_id % 13) || ', description: described' FROM flow_admissions
    UNION ALL SELECT DISTINCT subject_id, 23, 'ED Visits: ', concat_ws(', ', 'period: ' || {{period}}, 'disposition: ' || disposition,
        'arrival_transport: ' || arrival_transport) AS item FROM (SELECT t.*, e.disposition, e.arrival_transport FROM transfers t
        LEFT JOIN edstays e ON e.stay_id = t.transfer_id WHERE t.eventtype = 'ed') WHERE item <> ''
    UNION ALL SELECT DISTINCT subject_id, 24, 'Unit Admissions: ', concat_ws(', ', 'careunit: ' || careunit, 'period: ' || {{period}},
        'service_given: ' || service_given) FROM g_stays WHERE label = 'UnitAdmission'
    UNION ALL SELECT DISTINCT s.subject_id, 25, 'ICU Stays: ', concat_ws(', ', 'careunit: ' || careunit, 'period: ' || {{period_s}},
        'service_given: ' || service_given, 'first_careunit: ' || first_careunit, 'last_careunit: ' || last_careunit, 'los: ' || {floats('los')})
        FROM g_stays s JOIN icustays i ON s.event_id = CAST(i.stay_id AS VARCHAR) WHERE label = 'ICUStay')"""


def _items_sql() -> str:
    from wardgraph.suite.sql_views import period

    return ITEMS.replace("{period_s}", period("s.intime", "s.outtime")).replace("{period}", period("intime", "outtime"))


@query(
    "a13_collect_distinct_maps",
    f"""WITH {_items_sql()} SELECT subject_id, CASE rank WHEN 18 THEN 'lab_events' WHEN 27 THEN 'drg_codes' WHEN 23 THEN 'ed_visits'
               WHEN 24 THEN 'unit_admissions' ELSE 'icu_stays' END AS category, count(*) AS items FROM items GROUP BY ALL""",
)
def a13(v: Views) -> DataFrame:
    return text_items(v).groupBy("subject_id", "category").agg(F.count(F.lit(1)).alias("items"))


STOP_SQL = """trim(regexp_replace(regexp_replace(array_to_string(list_filter(
    regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w) NOT IN ({stop})), ''),
    '\\s*([|:])\\s*', ' \\1 ', 'g'), '\\s+', ' ', 'g'))"""


def _stop_sql(c: str) -> str:
    from wardgraph.suite.scalars import STOP

    return STOP_SQL.format(c=c, stop=STOP)


VIEWS["patient_texts"] = f"""
    WITH {_items_sql()},
        sections AS (SELECT subject_id, rank, heading || string_agg(item, '; ' ORDER BY item) AS s FROM items GROUP BY subject_id, rank, heading),
        joined AS (SELECT subject_id, string_agg(s, ' | ' ORDER BY rank) AS s FROM sections GROUP BY subject_id),
        counts AS (SELECT subject_id, count(*) AS n FROM flow_admissions GROUP BY 1),
        full_text AS (SELECT p.subject_id, concat_ws(' | ', 'Patient ID: ' || p.subject_id, 'Patient: ' || concat_ws(', ', 'Gender: ' || gender,
            'Age: ' || anchor_age, 'Year Group: ' || anchor_year_group, 'Date of Death: ' || dod, 'Total Admissions: ' || n), s) AS t
            FROM patients p LEFT JOIN joined USING (subject_id) LEFT JOIN counts USING (subject_id))
    SELECT subject_id, {_stop_sql('t')} AS text FROM full_text"""


@query("p17_patient_text", "SELECT subject_id, text FROM patient_texts")
def p17(v: Views) -> DataFrame:
    return patient_texts(v)


def patient_texts(v: Views) -> DataFrame:
    counts = v.flow_admissions.groupBy("subject_id").agg(F.count(F.lit(1)).alias("total_number_of_admissions"))
    return embedding.patient_text(v.patients.join(counts, "subject_id", "left"), text_items(v))


def patient_chunks(v: Views) -> DataFrame:
    counts = v.flow_admissions.groupBy("subject_id").agg(F.count(F.lit(1)).alias("total_number_of_admissions"))
    made = embedding.patient_chunks(v.patients.join(counts, "subject_id", "left"), text_items(v))
    return v.once("patient_chunks", lambda: made)


@query(
    "p18_patient_chunks",
    f"""WITH {hashed('patient_texts', 'subject_id').split('tokens AS')[0].rstrip().rstrip(',')}
        SELECT subject_id, CAST(n AS BIGINT) AS chunk_no, array_to_string(words[n * {embedding.CHUNK_WORDS - embedding.OVERLAP_WORDS} + 1
               : n * {embedding.CHUNK_WORDS - embedding.OVERLAP_WORDS} + {embedding.CHUNK_WORDS}], ' ') AS chunk FROM starts""",
)
def p18_patients(v: Views) -> DataFrame:
    """Chunks of patient texts that were never whole, equal to those of the whole text."""
    return patient_chunks(v)


# The counter of the check: four characters are a token.
CHARS_PER_TOKEN = 4


def character_tokens(word: str) -> int:
    return -(-len(word) // CHARS_PER_TOKEN)


@query(
    "p18_token_chunks",
    f"""WITH words AS (SELECT subject_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
            SELECT subject_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM patient_texts)),
        counted AS (SELECT *, CAST(ceil(length(word) / {CHARS_PER_TOKEN}.0) AS BIGINT) AS t FROM words),
        placed AS (SELECT *, sum(t) OVER (PARTITION BY subject_id ORDER BY i) AS e, sum(t) OVER (PARTITION BY subject_id) AS total FROM counted),
        spread AS (SELECT *, least(greatest(0, ceil((total - {embedding.CHUNK_WORDS}) / {embedding.CHUNK_WORDS - embedding.OVERLAP_WORDS}.0)),
            floor((e - t) / {embedding.CHUNK_WORDS - embedding.OVERLAP_WORDS}.0)) AS b,
            greatest(0, ceil((e - {embedding.CHUNK_WORDS}) / {embedding.CHUNK_WORDS - embedding.OVERLAP_WORDS}.0)) AS a FROM placed),
        laid AS (SELECT *, unnest(range(CAST(least(a, b) AS BIGINT), CAST(b AS BIGINT) + 1)) AS chunk_no FROM spread)
        SELECT subject_id, chunk_no, string_agg(word, ' ' ORDER BY i) AS chunk, CAST(sum(t) AS BIGINT) AS tokens FROM laid GROUP BY subject_id, chunk_no""",
)
def p18_tokens(v: Views) -> DataFrame:
    """Chunks of patient texts bounded by tokens, which the counter gives word by word."""
    counts = v.flow_admissions.groupBy("subject_id").agg(F.count(F.lit(1)).alias("total_number_of_admissions"))
    chunks = embedding.patient_chunks(v.patients.join(counts, "subject_id", "left"), text_items(v), count=character_tokens)
    tokens = F.aggregate(F.split("chunk", " "), F.lit(0).cast("bigint"), lambda n, w: n + F.ceil(F.length(w) / F.lit(CHARS_PER_TOKEN)))
    return chunks.select("subject_id", "chunk_no", "chunk", tokens.alias("tokens"))


@query(
    "v1_patient_embedding",
    f"""WITH {hashed('patient_texts', 'subject_id', 384)}
        SELECT subject_id, chunks, i AS place, round(CAST(x AS DOUBLE), 5) AS x FROM vectored""",
)
def v1(v: Views) -> DataFrame:
    """Patient facts to chunks to vectors to one vector per patient."""
    return _places(embedding.embed_chunks(patient_chunks(v), "subject_id", embedding.hashing_embedder()), "subject_id")


# --- comparison and summary ---------------------------------------------------------------


def compared_items(v: Views) -> DataFrame:
    dx = v.diagnoses.select("subject_id", F.lit("diagnoses").alias("category"), F.col("long_title").alias("item"))
    drugs = v.prescriptions.select("subject_id", F.lit("medications").alias("category"), F.col("drug").alias("item"))
    grown = v.microbiology.select("subject_id", F.lit("microbiology").alias("category"), F.col("org_name").alias("item"))
    return dx.unionByName(drugs).unionByName(grown)


COMPARED = """compared AS (SELECT subject_id, 'diagnoses' AS category, lower(long_title) AS item FROM diagnoses
    UNION ALL SELECT subject_id, 'medications', lower(drug) FROM prescriptions
    UNION ALL SELECT subject_id, 'microbiology', lower(org_name) FROM microbiology)"""


@query(
    "j5_patient_pair_compare",
    f"""WITH {COMPARED}, sides AS (SELECT category, item, bool_or(subject_id = {PAIR[0]}) AS a, bool_or(subject_id = {PAIR[1]}) AS b
            FROM compared WHERE subject_id IN {PAIR} AND item IS NOT NULL GROUP BY ALL)
        SELECT category, coalesce(string_agg(item, '; ' ORDER BY item) FILTER (a AND b), '') AS shared,
               coalesce(string_agg(item, '; ' ORDER BY item) FILTER (a AND NOT b), '') AS only_first,
               coalesce(string_agg(item, '; ' ORDER BY item) FILTER (b AND NOT a), '') AS only_second FROM sides GROUP BY category""",
)
def j5(v: Views) -> DataFrame:
    lists = comparison.pair_lists(compared_items(v), *PAIR)
    return lists.select("category", *[F.array_join(c, "; ").alias(c) for c in ["shared", "only_first", "only_second"]])


@query(
    "j6_patient_summary_facts",
    f"""WITH {COMPARED}, abnormal AS (SELECT DISTINCT l.subject_id, i.label AS item FROM labevents l JOIN d_items i USING (itemid)
            WHERE {facts.ABNORMAL})
        SELECT p.subject_id, gender, anchor_age,
          coalesce((SELECT string_agg(DISTINCT long_title, '; ' ORDER BY long_title) FROM diagnoses d WHERE d.subject_id = p.subject_id), '') AS diagnoses,
          coalesce((SELECT string_agg(DISTINCT drug, '; ' ORDER BY drug) FROM prescriptions d WHERE d.subject_id = p.subject_id), '') AS medications,
          coalesce((SELECT string_agg(DISTINCT org_name, '; ' ORDER BY org_name) FROM microbiology d WHERE d.subject_id = p.subject_id), '') AS microbiology,
          coalesce((SELECT string_agg(item, '; ' ORDER BY item) FROM abnormal d WHERE d.subject_id = p.subject_id), '') AS abnormal_labs
        FROM patients p""",
)
def j6(v: Views) -> DataFrame:
    abnormal = facts.lab_facts(v).where(facts.abnormal()).select("subject_id", F.col("label").alias("item"))
    categories = {
        "diagnoses": v.diagnoses.select("subject_id", F.col("long_title").alias("item")),
        "medications": v.prescriptions.select("subject_id", F.col("drug").alias("item")),
        "microbiology": v.microbiology.select("subject_id", F.col("org_name").alias("item")),
        "abnormal_labs": abnormal,
    }
    made = comparison.summary(v.patients.select("subject_id", "gender", "anchor_age"), categories)
    return made.select("subject_id", "gender", "anchor_age", *[F.array_join(c, "; ").alias(c) for c in categories])
