"""Stored tables that are merged by key.

Rows lie in buckets by the hash of their key. A merge reads the buckets that its rows
fall into, updates known keys, adds new ones, writes these buckets under a new version,
and only then a manifest that says which version of each bucket holds. A merge that
breaks off before its manifest changes nothing; repeated, it leaves what an unbroken
one leaves. A reader takes the manifest of the highest number and what it names.

One writer at a time. Manifests have at most as many rows as there are buckets; that
many rows, and no data, pass through the driver. A key is a list of columns, in which
nulls are equal to each other. Rows of a merge with equal keys count once: the one with
the greatest content as JSON.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardgraph.operators.upsert import upsert
from wardgraph.session import written
from wardgraph.sources import files

# Of a table of some hundred gigabytes; a table keeps the number it was begun with.
BUCKETS = 64
_MANIFEST = "seq bigint, bucket int, version string"


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """Number of the last finished merge, and the version of each bucket; (0, {}) for a new table."""
    all_ = files.optional(spark, lambda: spark.read.schema(_MANIFEST).json(f"{path}/manifest/*"), _MANIFEST)
    last = all_.agg(F.max("seq").alias("seq"))
    rows = all_.join(F.broadcast(last), "seq").collect()
    return (rows[0]["seq"] if rows else 0), {r["bucket"]: r["version"] for r in rows}


def exists(spark: SparkSession, path: str) -> bool:
    return manifest(spark, path)[0] > 0


def _read(spark: SparkSession, path: str, versions: dict[int, str]) -> DataFrame:
    places = [f"{path}/data/{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.option("mergeSchema", True).parquet(*places)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last finished merge left it; fails like a read of a path that is not there if there was none."""
    _, versions = manifest(spark, path)
    return _read(spark, path, versions) if versions else spark.read.json(f"{path}/manifest")


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _once(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")


def _same_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` with the columns that only ``b`` has, as nulls."""
    for f in b.schema.fields:
        if f.name not in a.columns:
            a = a.withColumn(f.name, F.lit(None).cast(f.dataType))
    return a


def prepare_merge(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS, on_match: Sequence[str] | None = None) -> tuple[int, dict[int, str]]:
    """Write the new versions of the buckets that ``rows`` touch; returns the manifest that ``finish`` makes valid."""
    spark = rows.sparkSession
    seq, versions = manifest(spark, path)
    given = written(_once(rows, keys).withColumn("bucket", _bucket(keys, buckets)), "merge")
    touched = sorted(r["bucket"] for r in given.select("bucket").distinct().collect())
    if not touched:
        return seq, versions
    before = {b: versions[b] for b in touched if b in versions}
    given = given.drop("bucket")
    merged = given
    if before:
        stored = _same_columns(_read(spark, path, before), given)
        # Columns that the merge does not bring stay as they are on known rows.
        match = [c for c in given.columns if c not in keys] if on_match is None else on_match
        merged = upsert(stored, given, keys, on_match=match)
    version = uuid.uuid4().hex
    merged.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{version}")
    return seq + 1, versions | dict.fromkeys(touched, version)


def finish(spark: SparkSession, path: str, seq: int, versions: dict[int, str]) -> None:
    """Make a manifest valid: readers see the merge from here on."""
    rows = [(seq, b, v) for b, v in versions.items()]
    if rows:
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{seq:012d}")


def merge(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS, on_match: Sequence[str] | None = None) -> None:
    """Add the rows of new keys, give those of known keys their new values (``on_match``: of these columns only)."""
    finish(rows.sparkSession, path, *prepare_merge(rows, path, keys, buckets, on_match))
