"""Whitening of embeddings: pivoted Cholesky of the scatter, then one-sided Jacobi on the factor.

Entries c become integers x = floor(1024 c) + 100000, so that sums are exact whatever
the order in which tasks add them. Spark makes three passes: the first gives the number
of vectors n and the sums S of each place, the second the scatter of y = x - floor(S/n)
(small integers, whose products of a batch and of all batches are exact below 2**53),
the third the results. Between the passes only sums reach the driver, at most the
square of the dimension, however many rows there are.

The covariance is put together exactly, V = (sum y y' - r r'/n) / n with r = S - n
floor(S/n), and rounded once. Pivoted Cholesky gives V = L L' with L triangular up to
the order of its rows; rotations make the columns of L orthogonal. The norms of the
rotated columns, squared, are the eigenvalues and the columns divided by their norms
the components, largest first; the entry of largest amount of each is positive.

Defined cases: a vector that is null, empty, or holds a null, NaN, infinite or huge
entry (an x of 2**53 or more) is dropped; the dimension is the length that most vectors
have (of equally frequent ones the largest) and vectors of other lengths are dropped;
there are no more components than V has rank, so equal vectors alone, like an empty
table, give no components; a deviation over 2**63 - 1 is null; other columns stay, those
with the names of added columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgraph.llm.common import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
OUTPUT = ["deviation", "whitened"]
# Numbers of a block of vectors.
BLOCK = 1 << 20
EXACT = 2.0**53
_EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Fit:
    """What the vectors have in common; ``components`` has one per column."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    trace: float = 0.0
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]

    def centres(self) -> tuple[list[int], list[int]]:
        """Whole part of each mean, and what is left of the sum."""
        return [s // self.n for s in self.sums], [s % self.n for s in self.sums]


def _integers(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x of all entries; start and length of each row (length 0 if the row is dropped)."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(SCALE * entries) + SHIFT
        bad = ~(np.abs(x) < EXACT)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    lengths[rows[bad]] = 0
    return np.where(bad, 0, x).astype(np.int64), starts, lengths


def _blocks(batches: Iterator[pa.RecordBatch], dim: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of one length as a matrix, with the batch they are from and their places in it."""
    for batch in batches:
        x, starts, lengths = _integers(batch.column(0))
        for size in [dim] if dim is not None else sorted(set(lengths[lengths > 0].tolist())):
            rows = np.flatnonzero(lengths == size)
            step = max(1, BLOCK // size)
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                yield batch, part, x[starts[part][:, None] + np.arange(size)]


def _sum_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, place, n, high, low): the sum of a place is 2**32 high + low."""
    total: dict[int, list] = {}
    for _, rows, x in _blocks(batches):
        own = total.setdefault(x.shape[1], [0, 0, 0])
        for k, more in enumerate((len(rows), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))):
            own[k] = own[k] + more
    for size, (n, high, low) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n, np.int64)), pa.array(high), pa.array(low)],
            names=["dim", "place", "n", "high", "low"],
        )


def _sums(df: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Number of vectors of the most frequent length, and their sums."""
    each = df.select(vector).mapInArrow(_sum_of, "dim int, place int, n long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("n", "high", "low")]
    sums = written(each.groupBy("dim", "place").agg(*exact), "sums")
    most = sums.groupBy("dim").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).head(1)
    if not most:
        return 0, []
    rows = sums.filter(F.col("dim") == most[0]["dim"]).orderBy("place").collect()
    return int(most[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def _products(blocks, size: int) -> Iterator[pa.RecordBatch]:
    """(cell, value): the upper triangle of the products of centred rows."""
    upper, total = np.triu_indices(size), np.zeros((size, size))
    for z in blocks:
        total += z.T @ z
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int64)), pa.array(total[upper])], names=["cell", "value"])


def _scatter(df: DataFrame, run, size: int) -> np.ndarray:
    """Sum over all tasks as a whole matrix."""
    summed = df.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros((size, size))
    values = np.zeros(size * (size + 1) // 2)
    for r in summed.collect():
        values[r["cell"]] = r["value"]
    out[np.triu_indices(size)] = values
    return out + np.triu(out, 1).T


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L of V = L L', columns by falling pivot, as many as V has rank."""
    size = len(v)
    left, factor, used = np.diag(v).copy(), np.zeros((size, size)), np.zeros(size, bool)
    least = size * _EPS * max(left.max(initial=0.0), 0.0)
    for k in range(size):
        p = int(np.argmax(np.where(used, -np.inf, left)))
        if not left[p] > least:
            return factor[:, :k]
        column = (v[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        column[used] = 0.0
        column[p] = np.sqrt(left[p])
        factor[:, k], used[p] = column, True
        left -= column**2
    return factor


def orthogonal_columns(w: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns rotated in pairs until all are orthogonal; the pairs of a round share no column."""
    w = w.copy()
    count = w.shape[1]
    ring = list(range(count + count % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if max(a, b) < count]
            p, q = np.array(pairs).T
            a, b, c = (w[:, p] ** 2).sum(0), (w[:, q] ** 2).sum(0), (w[:, p] * w[:, q]).sum(0)
            size = np.sqrt(a * b)
            turn = np.abs(c) > _EPS * size
            worst = max(worst, float((np.abs(c[turn]) / size[turn]).max(initial=0.0)))
            zeta = (b - a) / np.where(turn, 2 * c, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            w[:, p], w[:, q] = cos * w[:, p] - cos * t * w[:, q], cos * t * w[:, p] + cos * w[:, q]
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst <= 4 * _EPS * max(len(w), 1):
            break
    return w


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as columns, as many as V has rank."""
    factor = pivoted_cholesky(v)
    w = orthogonal_columns(factor) if factor.shape[1] > 1 else factor
    norms = np.sqrt((w**2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    w = w[:, order] / norms[order]
    heads = w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])] if w.size else np.zeros(0)
    return norms[order] ** 2, w * np.where(heads < 0, -1.0, 1.0)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Fit:
    """The first ``components`` components of all vectors."""
    n, sums = _sums(df, vector)
    if not n:
        return Fit()
    plain_fit = Fit(n, sums)
    centres, rest = plain_fit.centres()
    size = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.array(centres, np.int64)
        return _products(((x - centre).astype(np.float64) for _, _, x in _blocks(batches, size)), size)

    scatter = _scatter(df.select(vector), run, size)
    exact = [[Fraction(n * int(scatter[i, j]) - rest[i] * rest[j], n * n) if j >= i else 0 for j in range(size)] for i in range(size)]
    v = np.array([[float(exact[min(i, j)][max(i, j)]) for j in range(size)] for i in range(size)])
    values, vectors = eigen(v)
    return Fit(n, sums, float(sum(exact[i][i] for i in range(size))), values[:components], vectors[:, :components])


def _deviations(y: np.ndarray, rest: list[int], n: int) -> list[int | None] | np.ndarray:
    """Sums of (n x - S)**2 over the places; None where one does not fit a long."""
    largest = int(np.abs(y).max(initial=0)) + 1
    if y.shape[1] * (n * largest) ** 2 < 2**63:
        return ((n * y - np.array(rest, np.int64)) ** 2).sum(axis=1)
    whole = y.astype(object)
    sums = ((n * whole - np.array(rest, object)) ** 2).sum(axis=1)
    return [int(s) if s < 2**63 else None for s in sums]


def whiten(df: DataFrame, fitted: Fit, vector: str = "embedding") -> DataFrame:
    """The rows with a usable vector, with ``deviation`` and ``whitened`` (one double for each component)."""
    names = [c for c in df.columns if c not in OUTPUT]
    kept = [c for c in names if c != vector]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType(), False))])
    rows = df.select(vector, *kept)
    if not len(fitted.values):
        return rows.limit(0).select(*names, F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    size, n, k = fitted.dim, fitted.n, len(fitted.values)
    centres, rest = fitted.centres()
    turned = fitted.components / np.sqrt(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, means = np.array(centres, np.int64), np.array([r / n for r in rest])
        for batch, part, x in _blocks(batches, size):
            y = x - centre
            flat = pa.array(((y - means) @ turned).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k, dtype=np.int32)), flat)
            own = batch.take(pa.array(part))
            made = {"deviation": pa.array(_deviations(y, rest, n), pa.int64()), "whitened": lists} | {c: own.column(i) for i, c in enumerate([vector, *kept])}
            yield pa.RecordBatch.from_arrays([made[f.name] for f in schema.fields], names=schema.names)

    return rows.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest amount by which the covariance of ``whitened`` differs from the identity."""
    means = whitened.select(F.posexplode("whitened").alias("place", "w")).groupBy("place").agg(F.avg("w").alias("mean"), F.count("*").alias("n")).collect()
    if not means:
        return 0.0
    mean = np.array([m for _, m in sorted((r["place"], r["mean"]) for r in means)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _products((b.column(0).flatten().to_numpy().reshape(-1, components) - mean for b in batches), components)

    covariance = _scatter(whitened.select("whitened"), run, components) / means[0]["n"]
    return float(np.abs(covariance - np.eye(components)).max())


def whitened_components(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: the other columns, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [c for c in df.columns if c != vector and c not in made]
    fitted = fit(df, vector, components)
    rows = written(whiten(df.select(vector, *kept), fitted, vector).drop(vector), "whitened")
    error = identity_error(rows, len(fitted.values))
    explained = F.array(*[F.lit(e) for e in fitted.explained]) if len(fitted.values) else F.array().cast("array<double>")
    each = rows.select(*kept, "deviation", F.posexplode("whitened").alias("_place", "_whitened"))
    return each.select(
        *kept, (F.col("_place") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", F.col("_whitened").alias("whitened"),
        F.get(explained, F.col("_place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
