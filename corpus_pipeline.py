"""From raw documents to a training mix: each stage works on all that the one before kept.

Every stage is written to the shared folder and read again before the next begins.
A scored or learned stage can't be said in SQL, so ORACLE_SQL is None; the tests hold
each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgraph.llm import decontaminate, lines, mixing, neardup, quality
from wardgraph.llm.common import written
from wardgraph.llm.queries import held_out, with_quality
from wardgraph.session import prepare

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; those it rejects go."""
    labels = _table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    forest = quality.train(docs, labels)
    return quality.score(docs, forest, column="_score").filter(F.col("_score") >= quality.GOOD).select(*docs.columns)


def without_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sites; n_chars is that of the text left."""
    prepare(spark)
    return _sized(lines.remove_spread_lines(docs, site_share=lines.SITE_SHARE), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by the shingles and the similarity of the operator."""
    prepare(spark)
    return neardup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often and how many words."""
    weighed = with_quality(docs, _table(spark, sf_dir, "labels"))
    taken = mixing.mix(weighed, quality=F.col("_weight")).filter("copies > 0")
    return taken.select(*docs.columns, *[c for c in mixing.OUTPUT if c not in docs.columns])


def _sized(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars counted anew where there is such a column."""
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_spread_lines),
    ("near duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
