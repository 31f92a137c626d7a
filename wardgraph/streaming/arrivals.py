"""Arriving notes and orders as streams.

The batch jobs skip what is already there; a stream with ``availableNow``
does the same work on the files that are new, and remembers them itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardgraph.operators.upsert import only_new
from wardgraph.plans import notes
from wardgraph.sources import files, schemas


def read_arriving_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schemas.NOTE["discharge"]).parquet(folder)


def document_stream(arriving: DataFrame, documents: str, checkpoint: str):
    """Append the document of each note that has none; runs until the folder is read.

    A batch that is run again after a failure finds its notes done, so every
    note has one document.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(["note_id"])
        done = files.optional(
            spark, lambda: spark.read.schema(schemas.NOTES_JSON).parquet(documents), schemas.NOTES_JSON
        )
        files.append(notes.documents(notes.read_notes(only_new(once, done, ["note_id"]))), documents)

    return (
        arriving.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_orders(arriving: DataFrame, time: str = "starttime", delay: str = "1 day") -> DataFrame:
    """First row of each order number in a stream; rows without a number all pass.

    Order numbers are forgotten once the watermark has passed them by, so the
    state stays as small as ``delay``.
    """
    marked = arriving.withWatermark(time, delay)
    keyed = marked.where("poe_id IS NOT NULL").dropDuplicatesWithinWatermark(["poe_id"])
    return keyed.union(marked.where("poe_id IS NULL"))
