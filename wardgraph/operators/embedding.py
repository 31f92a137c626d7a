"""From patient facts to one text, and from texts to one vector per patient."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType

from wardgraph.functions import text as tx
from wardgraph.functions.vectors import mean_vector
from wardgraph.operators import ordered
from wardgraph.session import written

# Categories of a patient's text, in order, with their headings.
CATEGORIES = [
    ("diagnoses", "Diagnoses"),
    ("allergies", "Allergies"),
    ("discharge_notes", "Discharge Notes"),
    ("medications_started", "Medications Started"),
    ("medications_stopped", "Medications Stopped"),
    ("medications_to_avoid", "Medications to Avoid"),
    ("admission_medications", "Admission Medications"),
    ("discharge_medications", "Discharge Medications"),
    ("prescriptions", "Prescriptions"),
    ("hpi_summaries", "HPI Summaries"),
    ("procedures", "Procedures"),
    ("admissions", "Admissions"),
    ("discharges", "Discharges"),
    ("admission_labs", "Admission Labs"),
    ("discharge_labs", "Discharge Labs"),
    ("admission_vitals", "Admission Vitals"),
    ("discharge_vitals", "Discharge Vitals"),
    ("assessments", "Assessments"),
    ("lab_events", "Lab Events"),
    ("microbiology_events", "Microbiology Events"),
    ("previous_meds", "Previous Medications"),
    ("administered_meds", "Administered Medications"),
    ("past_history", "Past History"),
    ("ed_visits", "ED Visits"),
    ("unit_admissions", "Unit Admissions"),
    ("icu_stays", "ICU Stays"),
    ("chart_events", "Chart Events"),
    ("drg_codes", "DRG Codes"),
]
# Label and columns each category is drawn from. A list column
# gives one item per entry; several columns give one item "k: v, k: v".
SOURCES = {
    "diagnoses": ("Diagnosis", ["ed_diagnosis", "complete_diagnosis", "primary_diagnoses", "secondary_diagnoses"]),
    "allergies": ("AllergyIdentified", ["allergy_name"]),
    "discharge_notes": (
        "DischargeClinicalNote",
        ["hospital_course", "antibiotic_plan", "code_status", "microbiology_findings", "imaging_studies", "disposition",
         "mental_status", "level_of_consciousness", "activity_status", "discharge_instructions"],
    ),
    "medications_started": ("MedicationStarted", ["medications"]),
    "medications_stopped": ("MedicationStopped", ["medications"]),
    "medications_to_avoid": ("MedicationToAvoid", ["medications"]),
    "admission_medications": ("AdmissionMedications", ["medications"]),
    "discharge_medications": ("DischargeMedications", ["medications"]),
    "prescriptions": ("Prescription", ["medicines"]),
    "hpi_summaries": ("HPISummary", ["summary"]),
    "procedures": ("Procedures", ["procedures"]),
    "admissions": (
        "HospitalAdmission",
        ["admission_type", "admission_location", "discharge_location", "insurance", "language", "marital_status", "race",
         "service", "chief_complaint", "social_history", "family_history", "hospital_expire_flag"],
    ),
    "discharges": ("Discharge", ["disposition", "facility_name", "allergies", "major_procedure"]),
    "admission_labs": ("AdmissionLabs", ["lab_tests"]),
    "discharge_labs": ("DischargeLabs", ["lab_tests"]),
    "admission_vitals": ("AdmissionVitals", ["vitals"]),
    "discharge_vitals": ("DischargeVitals", ["vitals"]),
    "assessments": (
        "InitialAssessment",
        ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain", "acuity", "chiefcomplaint"],
    ),
    "lab_events": ("LabEvent", ["lab_results"]),
    "microbiology_events": ("MicrobiologyEvent", ["micro_results"]),
    "previous_meds": ("PreviousPrescriptionMeds", ["medications"]),
    "administered_meds": ("AdministeredMeds", ["medications"]),
    "past_history": ("PatientPastHistory", ["past_medical_history", "social_history", "family_history"]),
    "ed_visits": ("EmergencyDepartment", ["period", "disposition", "arrival_transport"]),
    "unit_admissions": ("UnitAdmission", ["careunit", "period", "service_given"]),
    "icu_stays": ("ICUStay", ["careunit", "period", "service_given", "first_careunit", "last_careunit", "los"]),
    "chart_events": ("ChartEvent", ["chart_measurements"]),
    "drg_codes": ("DRG", ["drg_type", "drg_code", "description", "drg_severity", "drg_mortality"]),
}

# Limits of the text model: tokens per chunk, tokens kept free,
# characters of overlap, characters per token.
MODEL_TOKENS = 256
SPARE_TOKENS = 20
OVERLAP_CHARS = 50
CHUNK_WORDS = MODEL_TOKENS - SPARE_TOKENS
OVERLAP_WORDS = max(10, OVERLAP_CHARS // 4)
CHUNK_CHARS = int(MODEL_TOKENS * 4 * 0.8)


def _items(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row per item of a category: subject_id, item."""
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    present = [c for c in columns if c in kinds]
    if not present:
        return None
    if len(present) == 1 and kinds[present[0]].startswith("array"):
        return frame.select("subject_id", F.explode(present[0]).alias("item"))

    def shown(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.array_join(c, ", ")
        if kinds[c].startswith("map"):
            return tx.map_text(F.col(c), [])
        return F.col(c).cast("string")

    if len(present) == 1:
        return frame.select("subject_id", shown(present[0]).alias("item"))
    parts = [F.concat(F.lit(f"{c}: "), F.nullif(shown(c), F.lit(""))) for c in present]
    return frame.select("subject_id", F.concat_ws(", ", *parts).alias("item"))


def distinct_items(frames: dict[str, DataFrame]) -> DataFrame:
    """Different items per patient and category, from the node frames of a graph."""
    out = None
    for rank, (name, _) in enumerate(CATEGORIES):
        label, columns = SOURCES[name]
        items = _items(frames[label], columns) if label in frames else None
        if items is None:
            continue
        one = items.where(F.col("item") != "").select(
            "subject_id", F.lit(rank).alias("rank"), F.lit(name).alias("category"), "item"
        )
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _heading() -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for rank, (_, heading) in enumerate(CATEGORIES):
        out = out.when(F.col("rank") == rank, F.lit(heading + ": "))
    return out


def _about(patients: DataFrame) -> Column:
    """Number and demographics, the first two sections of a patient's text."""

    def attribute(heading: str, c: str) -> Column:
        known = F.col(c).cast("string") if c in patients.columns else F.lit(None).cast("string")
        shown = F.nullif(F.nullif(known, F.lit("")), F.lit("0"))
        return F.concat(F.lit(heading + ": "), shown)

    told = F.concat_ws(
        ", ",
        attribute("Gender", "gender"),
        attribute("Age", "anchor_age"),
        attribute("Year Group", "anchor_year_group"),
        attribute("Date of Death", "dod"),
        attribute("Total Admissions", "total_number_of_admissions"),
    )
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Patient ID: "), F.col("subject_id").cast("string")),
        F.concat(F.lit("Patient: "), F.nullif(told, F.lit(""))),
    )


def patient_text(patients: DataFrame, items: DataFrame) -> DataFrame:
    """One text per patient: number, demographics, then the categories in order.

    All categories go through the same two groupings, whatever their number.
    The text is one row by its nature; ``patient_chunks`` leads to vectors
    without it.
    """
    listed = items.groupBy("subject_id", "rank").agg(F.array_sort(F.collect_list("item")).alias("list"))
    sections = listed.select(
        "subject_id", F.struct("rank", F.concat(_heading(), F.array_join("list", "; ")).alias("text")).alias("s")
    )
    whole = sections.groupBy("subject_id").agg(F.array_sort(F.collect_list("s")).alias("parts"))
    full = F.concat_ws(" | ", _about(patients), F.array_join(F.transform("parts", lambda p: p["text"]), " | "))
    return patients.join(whole, "subject_id", "left").select("subject_id", tx.remove_stop_words(full).alias("text"))


def token_ends(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """Running token counts of the words of a list; ``count`` says how many tokens a word is to the model.

    A word is counted once a batch, however often it occurs.
    """

    def ends(lists: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def one(words) -> np.ndarray:
            for word in words:
                if word not in known:
                    known[word] = count(word)
            return np.cumsum([known[word] for word in words], dtype="int64")

        return lists.map(one, na_action="ignore")

    return F.pandas_udf(ends, ArrayType(LongType()))


# Words of a list that are laid out on chunks together.
PART_WORDS = 512


def token_chunks(
    worded: DataFrame, key: str, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS
) -> DataFrame:
    """(key, chunk_no, chunk): chunks of at most ``size`` tokens, whole words, each ``overlap`` tokens into the one before.

    ``worded`` has the pieces of the texts: key, start (tokens before the piece),
    words, ends (running token counts) and total (tokens of the text). Chunk k
    holds the words that lie within tokens k * step to k * step + size. Where a
    word lies follows from the sums alone, so no chunk waits for the one before
    and no text is ever whole. A word of more tokens than ``overlap`` may fit no
    chunk; it stays whole in the one it begins in, which is then longer than
    ``size``. Numbers rise along the text; a word longer than a step leaves some out.
    """
    step = size - overlap
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(PART_WORDS)))
    parts = worded.where(F.size("words") > 0).select("*", at.alias("at"))
    upto = F.slice("ends", F.col("at") + 1, F.lit(PART_WORDS))
    before = F.when(F.col("at") > 0, F.get("ends", F.col("at") - 1)).otherwise(F.lit(0))
    begins = F.slice(F.concat(F.array(before), upto), F.lit(1), F.size(upto))
    parts = parts.select(
        key, "total", (F.col("start") + before).alias("place"), F.slice("words", F.col("at") + 1, F.lit(PART_WORDS)).alias("words"),
        F.transform(begins, lambda x: x + F.col("start")).alias("begins"), F.transform(upto, lambda x: x + F.col("start")).alias("ends"),
    )
    final = F.greatest(F.lit(0), F.ceil((F.col("total") - size) / F.lit(step)))

    def last(begin: Column) -> Column:
        return F.least(final, F.floor(begin / F.lit(step)))

    def first(begin: Column, end: Column) -> Column:
        return F.least(last(begin), F.greatest(F.lit(0), F.ceil((end - size) / F.lit(step))))

    placed = F.arrays_zip("words", "begins", "ends")
    placed = F.transform(placed, lambda w: F.struct(w["words"].alias("w"), first(w["begins"], w["ends"]).alias("a"), last(w["begins"]).alias("b")))
    laid = parts.select(key, "place", placed.alias("placed"))
    laid = laid.withColumn("chunk_no", F.explode(F.sequence(F.get("placed", F.lit(0))["a"], F.element_at("placed", -1)["b"])))
    mine = F.filter("placed", lambda w: (w["a"] <= F.col("chunk_no")) & (w["b"] >= F.col("chunk_no")))
    laid = laid.select(key, "chunk_no", "place", F.transform(mine, lambda w: w["w"]).alias("w")).where(F.size("w") > 0)
    listed = F.array_sort(F.collect_list(F.struct("place", "w")))
    return laid.groupBy(key, "chunk_no").agg(
        F.array_join(F.flatten(F.transform(listed, lambda p: p["w"])), " ").alias("chunk")
    )


def patient_chunks(
    patients: DataFrame,
    items: DataFrame,
    save: Callable[[DataFrame, str], DataFrame] = written,
    count: Callable[[str], int] | None = None,
) -> DataFrame:
    """(subject_id, chunk_no, chunk): the chunks of ``patient_text``, put together from the items.

    No text is ever whole: each item knows how many words come before it, goes
    to the one or two chunks it falls into, and a chunk gathers at most
    ``CHUNK_WORDS`` words. A patient with very many items is many small groups.
    With ``count``, the tokens of a word, chunks are bounded by tokens in place of
    words; see ``token_chunks``.
    """
    about = patients.select("subject_id", F.lit(-1).alias("rank"), F.lit("").alias("item"), _about(patients).alias("body"))
    rows = about.unionByName(items.select("subject_id", "rank", "item", F.col("item").alias("body")))
    # Slices that never fall along (rank, item); a rank of -1 sorts first as text too.
    slice_by = F.concat(F.lpad(F.col("rank").cast("string"), 3, "0"), F.substring("item", 1, 12))

    def along(df: DataFrame, *specs) -> DataFrame:
        return ordered.along(df, ["subject_id"], ["rank", "item"], *specs, slice_by=slice_by)

    placed = along(
        rows, ordered.previous("before", F.col("rank")), ordered.next_known("after", F.col("rank"))
    )
    # A piece ends with the mark that parts it from the next, and so in white space.
    opens = F.col("before").isNull() | (F.col("before") != F.col("rank"))
    mark = F.when(F.col("after") == F.col("rank"), "; ").when(F.col("after").isNotNull(), " | ").otherwise("")
    piece = F.concat(F.when(opens, F.coalesce(_heading(), F.lit(""))).otherwise(""), F.col("body"), mark)
    worded = placed.select("subject_id", "rank", "item", tx.kept_words(piece).alias("words"))
    # Stored, because three readers follow and the text work is the costly part.
    worded = worded.withColumn("n", F.size("words").cast("bigint")).where(F.col("n") > 0)
    if count:
        worded = worded.withColumn("ends", token_ends(count)(F.col("words"))).withColumn("n", F.element_at("ends", -1))
    worded = save(worded, "words")
    counted = along(worded, ordered.total_before("start", F.col("n")))
    totals = worded.groupBy("subject_id").agg(F.sum("n").alias("total"))
    if count:
        return token_chunks(counted.join(totals, "subject_id"), "subject_id")

    step = CHUNK_WORDS - OVERLAP_WORDS
    start, n = F.col("start"), F.col("n")
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - CHUNK_WORDS) / F.lit(step)))
    first_chunk = F.greatest(F.lit(0), F.floor((start - CHUNK_WORDS) / F.lit(step)) + 1)
    last_chunk = F.least(last, F.floor((start + n - 1) / F.lit(step)))
    spread = counted.join(totals, "subject_id").where(first_chunk <= last_chunk).select(
        "subject_id", "start", "n", "words", F.explode(F.sequence(first_chunk, last_chunk)).alias("chunk_no")
    )
    begin = F.col("chunk_no") * step
    skip = F.greatest(F.lit(0), begin - start)
    upto = F.least(n, begin + CHUNK_WORDS - start)
    part = F.slice("words", (skip + 1).cast("int"), (upto - skip).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("start", part.alias("w"))))
    return spread.groupBy("subject_id", "chunk_no").agg(
        F.array_join(F.flatten(F.transform(parts, lambda p: p["w"])), " ").alias("chunk")
    )


def character_chunker(size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Callable[[Column], Column]:
    """Chunks of at most ``size`` characters, ended at the last ``.`` or ``|`` there is.

    One pattern says where a chunk ends: the longest run of at most ``size``
    characters that closes with a mark, else ``size`` characters. The next chunk
    takes up ``overlap`` characters of it again, and so depends on it.
    """
    piece = re.compile(rf"(?s).{{1,{size - 1}}}[.|]|.{{{size}}}")

    def pieces(text: str) -> Iterator[str]:
        begin = 0
        while len(text) - begin > size:
            found = piece.match(text, begin)
            yield found[0]
            begin = max(found.end() - overlap, begin + 1)
        yield text[begin:]

    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(pieces(t)), na_action="ignore")

    return F.pandas_udf(split, ArrayType(StringType()))


def hashing_embedder(dim: int = 384) -> Callable[[Column], Column]:
    """The default embedder: words hashed to ``dim`` slots, counted, unit length.

    It is deterministic and needs no model. A model takes its place as any
    function from a text column to a vector column, such as a pandas UDF.
    """

    def encode(texts: pd.Series) -> pd.Series:
        slots: dict[str, int] = {}

        def vector(t: str):
            counts = np.zeros(dim)
            for word in t.lower().split():
                if word not in slots:
                    slots[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
                counts[slots[word]] += 1
            length = np.sqrt((counts * counts).sum())
            return (counts / length if length else counts).astype("float32")

        return texts.map(lambda t: None if t is None else vector(t))

    return F.pandas_udf(encode, ArrayType(FloatType()))


def embed_chunks(chunks: DataFrame, key: str, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, vector, chunks): the mean of the vectors of the chunks of each key.

    ``chunks`` has one row per chunk with ``chunk_no`` and ``chunk``; they are
    encoded where they lie, and means are combined before the shuffle.
    """
    encode = embedder or hashing_embedder()
    encoded = chunks.select(key, encode(F.col("chunk")).alias("v"))
    return encoded.groupBy(key).agg(
        mean_vector(F.col("v")).cast("array<float>").alias("vector"), F.count(F.lit(1)).alias("chunks")
    )


def embed(
    texts: DataFrame,
    key: str,
    text: str,
    embedder: Callable[[Column], Column] | None = None,
    count: Callable[[str], int] | None = None,
) -> DataFrame:
    """Vectors of texts that are rows already, cut into chunks of words, or of tokens with ``count``.

    Texts without words have no vector and are left out. The chunks are spread
    over tasks before they are encoded, so one very long text is not one task.
    """
    worded = texts.where(F.trim(F.col(text)) != "")
    if count:
        words = worded.select(key, F.filter(F.split(F.col(text), "\\s+"), lambda w: w != "").alias("words"))
        ends = words.withColumn("ends", token_ends(count)(F.col("words")))
        pieces = ends.withColumn("total", F.element_at("ends", -1)).withColumn("start", F.lit(0).cast("bigint"))
        return embed_chunks(token_chunks(pieces, key), key, embedder)
    chunks = worded.select(
        key, F.posexplode(tx.chunk_by_words(F.col(text), CHUNK_WORDS, OVERLAP_WORDS)).alias("chunk_no", "chunk")
    )
    return embed_chunks(chunks.repartition(key, "chunk_no"), key, embedder)
