"""The whole run: tables to notes to graph to vectors, for the patients not done yet.

Each step finds its own pending patients, from what is stored and the log, and
writes by key. So a run that broke anywhere is taken up by the next one, which
leaves what an unbroken run would have left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgraph.functions.text import join_diagnoses
from wardgraph.operators import embedding, quality, tracker
from wardgraph.plans import notes
from wardgraph.plans.build import build, save_graph
from wardgraph.session import prepare, written
from wardgraph.sources import files, schemas, store

GRAPH_STEP = "graph"
TEXT_STEP = "text_embeddings"
DIAGNOSIS_STEP = "diagnosis_embeddings"
# The names under which ``build`` knows two tables.
RENAMED = {"ed/diagnosis": "ed_diagnosis", "note/discharge": "discharge"}


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of a cohort cut that are there, by name."""
    found = {}
    for module, names in schemas.CATALOG.items():
        for name, ddl in names.items():
            if ddl is None:
                continue
            try:
                table = spark.read.parquet(f"{root}/{module}/{name}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            found[RENAMED.get(f"{module}/{name}", name)] = table
    return found


def read_log(spark: SparkSession, target: str) -> DataFrame:
    """The status log with ``seq``, the order of rows of one second."""
    schema = schemas.TRACKER + ", seq bigint"
    return files.optional(spark, lambda: spark.read.schema(schema).parquet(f"{target}/log"), schema)


def note_step(subjects: DataFrame, step: str, target: str, status: str = tracker.SUCCESS) -> None:
    """Append how ``step`` ended for the patients."""
    rows = tracker.entries(subjects, step, status).withColumn("seq", F.unix_micros(F.current_timestamp()))
    files.append(rows, f"{target}/log")


def logged(pending: DataFrame, step: str, target: str, work: Callable[[DataFrame], None]) -> DataFrame:
    """Do ``work`` for the pending patients, if there are any, and log how it ended; returns them."""
    pending = written(pending.select("subject_id").distinct(), "pending")
    if pending.isEmpty():
        return pending
    try:
        work(pending)
    except Exception:
        note_step(pending, step, target, tracker.FAILED)
        raise
    note_step(pending, step, target)
    return pending


def restricted(tables: dict[str, DataFrame], pending: DataFrame) -> dict[str, DataFrame]:
    """Tables cut to the pending patients; dictionaries stay whole."""
    return {
        name: t.join(pending, "subject_id", "left_semi") if "subject_id" in t.columns else t
        for name, t in tables.items()
    }


def stored_frames(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The stored node tables that texts are drawn from, by label."""
    found = {}
    for label in ["Patient", *{label for label, _ in embedding.SOURCES.values()}]:
        try:
            found[label] = store.read(spark, f"{target}/graph/nodes/{label}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    schema = "subject_id bigint, vector array<float>"
    return files.optional(spark, lambda: spark.read.parquet(path).select("subject_id", "vector"), schema)


def graph_step(tables: dict[str, DataFrame], target: str, pending: DataFrame) -> None:
    """Notes and graph of the pending patients; edges that break a rule are left out."""
    mine = restricted(tables, pending)
    if "discharge" in mine:
        documents = written(notes.documents(notes.read_notes(mine.pop("discharge"))), "documents")
        mine["notes_flat"] = written(notes.flatten(notes.parts_of(documents)), "notes_flat")
        files.append_new(documents, f"{target}/notes/documents", ["note_id"])
        files.append_new(mine["notes_flat"], f"{target}/notes/flat", ["note_id"])
    made = build(mine)
    made.edge_frames = [quality.delete_violations(made.edges())]
    save_graph(made, f"{target}/graph", mode="merge")


def text_step(frames: dict[str, DataFrame], target: str, embedder, pending: DataFrame) -> None:
    """Vectors of the texts of the pending patients, from the stored graph."""
    mine = restricted(frames, pending)
    items = written(embedding.distinct_items(mine), "items")
    chunks = embedding.patient_chunks(mine["Patient"], items)
    files.append_new(embedding.embed_chunks(chunks, "subject_id", embedder), f"{target}/vectors/text", ["subject_id"])


def diagnosis_step(texts: DataFrame, target: str, embedder, pending: DataFrame) -> None:
    """Vectors of the diagnoses of the pending patients."""
    mine = texts.join(pending, "subject_id", "left_semi")
    vectors = embedding.embed(mine, "subject_id", "text", embedder).join(mine.select("subject_id", "all_diagnoses"), "subject_id")
    files.append_new(vectors, f"{target}/vectors/diagnoses", ["subject_id"])


def run(spark: SparkSession, source: str, target: str, embedder=None) -> dict[str, int]:
    """Bring the notes, graph and vectors of ``target`` up to date with ``source``.

    A patient's graph is pending until the log calls it done, a vector until it is
    stored. Vectors are made from the stored graph, so a step that failed is done
    by the next run even if nothing else is new. Returns the number of patients
    that any step was done for.
    """
    prepare(spark)
    tables = read_tables(spark, source)
    everyone = tables["patients"].select("subject_id")
    built = tracker.done(read_log(spark, target), GRAPH_STEP).select("subject_id")
    done = [logged(everyone.join(built, "subject_id", "left_anti"), GRAPH_STEP, target, lambda p: graph_step(tables, target, p))]

    frames, log = stored_frames(spark, target), read_log(spark, target)
    if "Patient" in frames:
        patients = frames["Patient"]
        missing = tracker.needs_embedding(patients, stored_vectors(spark, f"{target}/vectors/text"), log, [GRAPH_STEP])
        done.append(logged(missing, TEXT_STEP, target, lambda p: text_step(frames, target, embedder, p)))
        if "all_diagnoses" in patients.columns:
            texts = patients.select("subject_id", "all_diagnoses", join_diagnoses(F.col("all_diagnoses")).alias("text"))
            texts = texts.where((F.size("all_diagnoses") > 0) & F.col("text").rlike("\\S"))
            missing = tracker.needs_embedding(texts, stored_vectors(spark, f"{target}/vectors/diagnoses"), log, [GRAPH_STEP])
            done.append(logged(missing, DIAGNOSIS_STEP, target, lambda p: diagnosis_step(texts, target, embedder, p)))
    everyone_done = done[0]
    for more in done[1:]:
        everyone_done = everyone_done.union(more)
    return {"patients": everyone_done.distinct().count()}
