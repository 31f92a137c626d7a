"""A stored index of vectors: unit vectors in cells, of which a search reads a few.

The centres of the cells are learnt on a bounded sample (the vectors of least hash).
Every vector is stored under the cell of its nearest centre, as a partition of the
table, so that a search for the cells nearest to its vector prunes all others and
ranks what it reads exactly. New vectors are added to the cells there are.

Cosines are products of unit vectors. Zero vectors, null vectors and vectors of another
length than the index's are not stored. A patient that is not stored finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgraph.functions.text import let
from wardgraph.functions.vectors import dot, norm
from wardgraph.operators.similarity import SAME
from wardgraph.session import written

SAMPLE = 20_000
CELLS = 32
# Vectors without any clusters need this many of the cells for a recall of 0.9 at 20.
PROBES = 22
# So many queries are scored together against each batch of stored vectors; more are joined with them.
BLOCK = 256
# The least score that rounds to 1 at the decimals of ``SAME``.
TWIN = 1 - 0.5 * 10.0**-SAME


@dataclass(frozen=True)
class Index:
    """Where an index is stored."""

    spark: SparkSession
    path: str

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    @property
    def centres(self) -> DataFrame:
        """(cell, centre), as many as the index has cells."""
        return self.spark.read.parquet(f"{self.path}/centres")


def _unit(vectors: DataFrame, key: str) -> DataFrame:
    sized = vectors.select(key, F.transform("vector", lambda x: x.cast("double")).alias("vector")).where(norm(F.col("vector")) > 0)
    # The norm is bound once: as a column it would be put into the lambda and computed for every place.
    unit = let(norm(F.col("vector")), lambda n: F.transform("vector", lambda x: x / n))
    return sized.select(key, unit.alias("unit"))


def _store(units: DataFrame, model: KMeansModel, path: str, mode: str) -> None:
    dim = len(model.clusterCenters()[0])
    fitting = units.where(F.size("unit") == dim).withColumn("_v", array_to_vector("unit"))
    model.transform(fitting).drop("_v").repartition("cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")


def build(vectors: DataFrame, path: str, key: str = "subject_id", cells: int = CELLS, sample: int = SAMPLE, seed: int = 7) -> Index:
    """Learn the cells and store all vectors (``key``, vector) in them."""
    units = _unit(vectors, key)
    size = units.groupBy(F.size("unit").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    units = units.join(F.broadcast(size.select("dim")), F.size("unit") == F.col("dim"), "left_semi")
    least = units.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(sample)
    kmeans = KMeans(featuresCol="_v", predictionCol="cell", k=cells, seed=seed, maxIter=15, distanceMeasure="cosine")
    # Each pass of the learning reads its sample again: from what is written, not from all vectors.
    learnt = written(least, "sample").coalesce(1)
    model = kmeans.fit(learnt.select(array_to_vector("unit").alias("_v")))
    model.write().overwrite().save(f"{path}/model")
    spark = vectors.sparkSession
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _store(units, model, path, "overwrite")
    return Index(spark, path)


def add(index: Index, vectors: DataFrame, key: str = "subject_id") -> None:
    """Store more vectors in the cells there are; those of a key that is stored already are left out."""
    new = _unit(vectors, key).join(index.vectors.select(key), key, "left_anti")
    _store(new, KMeansModel.load(f"{index.path}/model"), index.path, "append")


def _probed(index: Index, asked: DataFrame, probes: int) -> DataFrame:
    """``asked`` with the ``probes`` cells whose centres are nearest, one row each. The centres are one row of bounded size."""
    centres = index.centres.agg(F.collect_list(F.struct("cell", "centre"))).scalar()
    unit = F.col("unit")
    scored = F.transform("_centres", lambda c: F.struct((-dot(c["centre"], unit) / norm(c["centre"])).alias("d"), c["cell"].alias("cell")))
    cells = F.transform(F.slice(F.array_sort(scored), 1, probes), lambda x: x["cell"])
    return asked.withColumn("_centres", centres).withColumn("cell", F.explode(cells)).drop("_centres")


def _best_of_batches(rows: DataFrame, vector: str, key: str, asked: Sequence[Row], k: int, drop_same: bool, by_cell: bool) -> DataFrame:
    """(query, ``key``, score): of each batch of ``rows`` the k best for each query, and what ties with the last of them.

    ``asked`` is a bounded list of (query, unit, and cells if ``by_cell``) of one length. By cell the stored unit
    vectors of a query's cells are scored by their product; otherwise all other vectors by their cosine.
    """
    units = np.array([a["unit"] for a in asked], dtype="float64")
    queries = [a["query"] for a in asked]
    cells = [set(a["cells"]) for a in asked] if by_cell else []
    fields = [T.StructField("query", rows.schema[key].dataType), rows.schema[key], T.StructField("score", T.DoubleType())]

    # Inside, because a task may not have this module.
    def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Dot products of all rows, added up place by place as ``dot`` does, so that equal vectors score alike."""
        out = np.zeros((len(a), len(b)))
        for i in range(a.shape[1]):
            out += a[:, i, None] * b[None, :, i]
        return out

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.sqrt([products(u[None], u[None])[0, 0] for u in units])
        for batch in batches:
            keys = batch.column(key)
            stored = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(keys), -1)
            scores = products(stored, units)
            if by_cell:
                cell = batch.column("cell").to_numpy(zero_copy_only=False)
            else:
                own = np.zeros(len(keys))
                for i in range(stored.shape[1]):
                    own += stored[:, i] * stored[:, i]
                sizes = np.sqrt(own)[:, None] * lengths[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = scores / sizes
            for n, query in enumerate(queries):
                score = scores[:, n]
                if by_cell:
                    usable = np.isin(cell, list(cells[n]))
                else:
                    usable = pc.fill_null(pc.not_equal(keys, pa.scalar(query, keys.type)), False).to_numpy(zero_copy_only=False) & (sizes[:, n] != 0)
                if drop_same:
                    usable = usable & (score < TWIN)
                place = np.flatnonzero(usable)
                if len(place) > k:
                    ranked = np.where(np.isnan(score[place]), np.inf, score[place])
                    place = place[ranked >= np.partition(ranked, len(place) - k)[len(place) - k]]
                if len(place):
                    same = pa.array([query] * len(place), keys.type)
                    yield pa.RecordBatch.from_arrays([same, keys.take(pa.array(place)), pa.array(score[place])], names=["query", key, "score"])

    return rows.mapInArrow(best, T.StructType(fields))


def _ranked(met: DataFrame, k: int, key: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return met.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def search(index: Index, asked: DataFrame, k: int = 20, probes: int = PROBES, key: str = "subject_id", drop_same: bool = True) -> DataFrame:
    """(query, ``key``, score): the k nearest stored vectors of each row of ``asked`` (query, unit).

    With ``drop_same`` twins (score 1) are left out. Only the probed cells are read.
    Up to ``BLOCK`` queries are fetched when this is called, and only their best
    vectors of each batch are shuffled; more are joined with the vectors.
    """
    wanted = _probed(index, asked, probes)
    per_query = wanted.groupBy("query", "unit").agg(F.collect_set("cell").alias("cells"))
    few = per_query.limit(BLOCK + 1).collect()
    dim = len(index.centres.head()["centre"])
    alike = all(a["query"] is not None and len(a["unit"]) == dim and None not in a["unit"] for a in few)
    one_type = asked.schema["query"].dataType == index.vectors.schema[key].dataType
    if few and len(few) <= BLOCK and alike and one_type and len({a["query"] for a in few}) == len(few):
        near = index.vectors.join(F.broadcast(wanted.select("cell")), "cell", "left_semi").select(key, "unit", "cell")
        met = _best_of_batches(near, "unit", key, few, k, drop_same, by_cell=True)
    else:
        met = index.vectors.join(wanted.withColumnRenamed("unit", "_asked"), "cell").select("query", key, dot(F.col("unit"), F.col("_asked")).alias("score"))
        if drop_same:
            met = met.where(F.round("score", SAME) < 1.0)
    return _ranked(met, k, key)


def exact(vectors: DataFrame, asked: DataFrame, k: int = 20, key: str = "subject_id") -> DataFrame:
    """(query, ``key``, score): the k nearest other vectors of each of a bounded set of queries (query, unit), by all of them.

    Twins are left out, as are null and zero vectors and those of another length.
    """
    queries = asked.select(F.col("query").cast(vectors.schema[key].dataType).alias("query"), "unit").collect()
    met = None
    for dim in sorted({len(a["unit"]) for a in queries}) or [0]:
        rows = vectors.where((F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull())).select(key, "vector")
        one = _best_of_batches(rows, "vector", key, [a for a in queries if len(a["unit"]) == dim], k, True, by_cell=False)
        met = one if met is None else met.unionByName(one)
    return _ranked(met, k, key)


def asked_for(index: Index, subjects: Column, key: str = "subject_id") -> DataFrame:
    """(query, unit) of the stored vectors for which ``subjects`` holds."""
    return index.vectors.where(subjects).select(F.col(key).alias("query"), "unit")


def nearest_patients(index: Index, subject_id: int, k: int = 20, probes: int = PROBES) -> DataFrame:
    """The k other patients nearest to a stored one."""
    return search(index, asked_for(index, F.col("subject_id") == subject_id), k, probes).where(F.col("subject_id") != subject_id).drop("query")


def recall(found: DataFrame, exact: DataFrame, key: str = "subject_id") -> DataFrame:
    """One row: how many (query, key) pairs of ``exact`` are in ``found``, and the share."""
    hit = exact.join(found.select("query", key).withColumn("_hit", F.lit(1)), ["query", key], "left")
    return hit.agg(F.count("*").alias("expected"), F.count("_hit").alias("hits")).withColumn("recall", F.try_divide(F.col("hits").cast("double"), F.col("expected")))
