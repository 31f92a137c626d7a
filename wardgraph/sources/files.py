"""Reading and writing tables."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv_scan(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A CSV table with header. Columns are matched by name, so a file may have
    more columns, or the same in another order, than the schema names.

    Without a schema every column is text. Empty fields, quoted or not, and
    text that does not fit the type of its column become null.
    """
    df = spark.read.option("header", True).option("multiLine", False).option("escape", '"').csv(path)
    if schema is not None:
        declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        df = df.select(
            *[
                F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name)
                if f.name in df.columns
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in declared.fields
            ]
        )
    return df.select(*columns) if columns else df


def _records(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """(layout, block, no, record): the records of CSV files, from lines in whatever splits Spark reads them.

    ``lines`` has file, block (where the split begins), id (rising along a
    split) and value. Whether a line begins inside quotes follows from the
    number of quotes before it: those of its split, counted along the lines, and
    those of the splits before, one row a split. Lines are shuffled once, by
    split. Only what crosses the border of a split is grouped a second time.
    ``layouts`` gives each file a number, which goes along with its splits.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.withColumn("quotes", quotes.cast("bigint"))
    splits = counted.groupBy("file", "block").agg(F.sum("quotes").alias("held"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.join(layouts, "file").select(
        "file", "layout", "block", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before")
    )

    along = Window.partitionBy("file", "block").orderBy("id")
    upto = along.rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.col("before") + F.coalesce(F.sum("quotes").over(upto), F.lit(0))) % 2 == 1
    numbered = counted.join(before, ["file", "block"]).withColumn("begins", F.when(inside, 0).otherwise(1))
    numbered = numbered.withColumn("no", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("no").over(Window.partitionBy("file", "block"))
    numbered = numbered.withColumn("last", last)

    def joined(pieces: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(order, text)))
        return pieces.groupBy(*key).agg(F.array_join(F.transform(listed, lambda x: x[text]), "\n").alias("record"))

    pieces = joined(numbered, ["file", "layout", "block", "no", "last"], "id", "value")
    # A split's last record may run on into the next; number 0 is what runs on.
    whole = pieces.where((F.col("no") > 0) & (F.col("no") < F.col("last"))).select("layout", "block", "no", "record")
    ends = pieces.where((F.col("no") == 0) | (F.col("no") == F.col("last")))
    runs = Window.partitionBy("file").orderBy("block", "no").rowsBetween(Window.unboundedPreceding, 0)
    # Which record a piece belongs to is decided without its text.
    owner = F.last(F.when(F.col("no") > 0, F.struct("block", "no")), ignorenulls=True).over(runs)
    owned = ends.select("file", "block", "no", owner.alias("of"))
    texts = ends.join(owned, ["file", "block", "no"]).select("file", "layout", "of", F.col("block").alias("at"), "record")
    crossing = joined(texts, ["file", "layout", "of"], "at", "record")
    return whole.unionByName(crossing.select("layout", "of.block", "of.no", "record"))


def notes_csv_scan(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV table with header whose text fields hold line breaks inside quotes.

    Any file is read in as many splits as its size asks for, so one file of all
    notes is many tasks. Columns are matched by name with each file's own
    header; columns the header lacks are null. Empty fields, quoted or not, and
    text that does not fit its type become null. A quote inside a field must be
    doubled and its field quoted, as every CSV writer does it.
    """
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    # A file's header is its first line; a job's files have few different ones.
    first = lines.where(F.col("block") == 0).groupBy("file").agg(F.min_by("value", "id").alias("header"))
    first = first.withColumn("header", F.regexp_replace("header", "^\ufeff|\r$", ""))
    headers = [r["header"] for r in first.select("header").distinct().sort("header").collect()]
    number = F.array_position(F.array(*map(F.lit, headers)), F.col("header")) if headers else F.lit(0)
    records = _records(lines, first.select("file", number.alias("layout")))
    records = records.withColumn("record", F.regexp_replace("record", "\r$", ""))
    options = {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}

    def parsed(header: str) -> Column:
        names = next(csv.reader([header]), [])
        kinds = ", ".join(f"c{i} string" for i in range(max(len(names), 1)))
        read = F.from_csv("record", kinds, options)
        return F.struct(
            *[
                (
                    F.nullif(read[f"c{names.index(f.name)}"], F.lit("")).try_cast(f.dataType)
                    if f.name in names
                    else F.lit(None).cast(f.dataType)
                ).alias(f.name)
                for f in declared.fields
            ]
        )

    row = F.lit(None).cast(declared)
    for n, header in enumerate(headers, 1):
        row = F.when(F.col("layout") == n, parsed(header)).otherwise(row)
    body = records.where(~((F.col("block") == 0) & (F.col("no") == 1)) & (F.col("record") != ""))
    return body.select(row.alias("row")).select("row.*")


def optional(spark: SparkSession, read, schema: StructType | str) -> DataFrame:
    """What ``read()`` returns, or an empty table when its files do not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> None:
    """Append rows; an empty table still leaves its columns behind."""
    df.write.mode("append").parquet(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Append the rows whose keys are not stored yet; what is stored stays as it is.

    A repeat of a write that was broken off, or was done, adds no row twice.
    """
    spark = df.sparkSession
    stored = optional(spark, lambda: spark.read.parquet(path).select(*keys), df.select(*keys).schema)
    new = df.join(stored.distinct(), list(keys), "left_anti").select(*df.columns)
    new.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def csv_sink(df: DataFrame, path: str, mode: str = "append") -> None:
    """CSV files, each with its own header."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(header=True, escape='"', **kept).csv(path)


def json_lines(df: DataFrame, *keys: str) -> DataFrame:
    """One JSON document per row in ``json``, nulls kept, beside the key columns."""
    document = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(*keys, document.alias("json"))


def json_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def text_sink(lines: DataFrame, path: str, order: Sequence[str], text: str) -> None:
    """Text files with the lines in order; the names of the files sort in line order.

    Rows are ranged over ``order``, so a patient with very many lines is spread
    over several files instead of being one task.
    """
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.col(text).alias("value")).write.mode("overwrite").text(path)
