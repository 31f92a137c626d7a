"""Whitening beside exact sums and numpy's eigenvectors, on the given table and on hard rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardgraph.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def usable(vector, dim):
    return vector is not None and len(vector) == dim and all(c is not None and math.isfinite(c) for c in vector)


def beside_numpy(rows, found, dim, k):
    """``found`` (id -> component -> row) beside plain integers and numpy."""
    kept = {i: [math.floor(1024 * float(c)) + 100_000 for c in v] for i, v in rows if usable(v, dim)}
    n, sums = len(kept), [sum(x) for x in zip(*kept.values())]
    assert set(found) == set(kept)
    y = np.array([[n * a - s for a, s in zip(x, sums)] for x in kept.values()], dtype=object)
    v = np.array([[float(sum(y[:, i] * y[:, j])) / n**3 for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    for c in range(k):
        want = (y.astype(float) / n) @ vectors[:, c] / math.sqrt(values[c])
        got = np.array([found[i][c + 1]["whitened"] for i in kept])
        sign = 1 if want @ got > 0 else -1
        assert np.allclose(got, sign * want, rtol=1e-7, atol=1e-8)
    for i, whole in zip(kept, y):
        assert sorted(found[i]) == list(range(1, k + 1))
        for c, r in found[i].items():
            assert (r["n"], r["deviation"]) == (n, sum(whole**2))
            assert abs(r["explained"] / (values[c - 1] / np.trace(v)) - 1) < 1e-9
            assert r["identity_error"] < 1e-9


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_query_beside_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    beside_numpy(rows, by_id(queries.QUERIES["op12_embedding_whitening"](spark, SF).collect()), 64, 8)


def test_hard_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 + j) for j in range(5)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [math.nan] + [0.0] * 4), (104, [math.inf] + [0.0] * 4), (105, [1.0] * 4), (106, [1e300] * 5), (107, rows[0][1])]
    docs = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, component string, other int").repartition(3)
    made = whitening.whitened_components(docs)
    assert made.columns == ["vec_id", "other", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    beside_numpy([(i, v) for i, v in rows if i != 106], by_id(made.collect()), 5, 5)


def test_repeated_ids_and_null_ids_keep_their_rows(spark):
    rows = [(1, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [3.0, 1.0]), (None, [3.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitened_components(docs).count() == 8


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_no_spread_gives_no_components(spark, rows):
    assert whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_rank_bounds_the_components(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    made = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in made} == {1}
    assert abs(made[0]["explained"] - 1) < 1e-12


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(i % 2) * 1e6, 0.0]) for i in range(10)]
    rows.append((10, [1e6 * 2, 1.0]))
    made = whitening.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("component = 1").collect()
    x = {i: [math.floor(1024 * c) + 100_000 for c in v] for i, v in rows}
    sums = [sum(c) for c in zip(*x.values())]
    for r in made:
        want = sum((11 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums))
        assert r["deviation"] == (want if want < 2**63 else None)
    assert any(r["deviation"] is None for r in made)


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for size, rank in ((1, 1), (2, 2), (7, 3), (40, 40), (33, 20)):
        a = rng.normal(size=(size, rank)) * np.logspace(0, -4, rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape[1] <= size and np.allclose(factor @ factor.T, v, atol=1e-13)
        values, vectors = whitening.eigen(v)
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        want = np.linalg.eigvalsh(v)[::-1][: len(values)]
        assert np.allclose(values, want, rtol=1e-8, atol=1e-13)


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, many = whitening.fit(df.coalesce(1)), whitening.fit(df.repartition(7, F.rand(1)))
    assert one.sums == many.sums and (one.components == many.components).all()
