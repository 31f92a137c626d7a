"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Statistics come from the whole text in one pass (``statistics``, numpy over Arrow
batches). Trees are grown on a bounded sample of labelled rows (``MAX_ROWS``, those
of least hash), on values binned at sample quantiles, so that a split is a sum over
a histogram. The forest is kept as flat arrays (feature, threshold, children,
value); scoring walks all documents of a batch through all trees level by level.

Defined cases: null and empty texts have statistics of 0 and get a score like any
other; labels that are null are left out; several labels of one id count by their mean;
without labels, or with one class alone, the score is the share of good labels (0.5
without any). Input columns with the names of added columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgraph.llm.common import plain, written

MAX_ROWS = 20_000
BINS, DEPTH, TREES, RATE, LEAST = 64, 4, 60, 0.15, 5.0
GOOD = 0.7

FEATURES = [
    "log_words", "log_bytes", "word_bytes", "distinct_words", "distinct_windows", "dup_lines", "log_lines", "words_per_line",
    "upper", "digit", "space", "high", "punctuation", "symbols", "bars", "exclamations", "short_words",
]

# Byte classes, one column each, for a product with a text's byte counts.
_CLASSES = np.zeros((256, 8), np.float64)
for _k, _bytes in enumerate((range(65, 91), range(48, 58), [9, 10, 11, 12, 13, 32], range(128, 256), b".,;:?\"'()-", b"#*$%&<>@^~_=+\\/", b"|", b"!")):
    _CLASSES[list(_bytes), _k] = 1


def statistics(text: str) -> list[float]:
    """The features of one text."""
    data = text.encode()
    words = data.split()
    n, size = len(words), len(data)
    if n == 0:
        return [0.0] * len(FEATURES)
    lines = [x for x in data.split(b"\n") if x.strip()]
    classes = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES
    upper, digit, space, high, punctuation, symbols, bars, exclamations = classes
    letters = max(1.0, size - space)
    return [
        np.log1p(n), np.log1p(size), (size - space) / n, len(set(words)) / n, len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2), 1 - len(set(lines)) / len(lines), np.log1p(len(lines)), n / len(lines),
        upper / letters, digit / letters, space / size, high / letters, punctuation / n, symbols / n, bars / n, exclamations / n, sum(len(w) < 4 for w in words) / n,
    ]


@dataclass
class Forest:
    """Trees as arrays of shape (trees, nodes); a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the good class for the rows of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in zip(self.feature, self.threshold, self.left, self.right, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost TREES trees of DEPTH levels on the log loss."""
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        none = np.zeros((0, 1))
        return Forest(none.astype(int), none, none.astype(int), none.astype(int), none, float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    p = float(np.clip(y.mean(), 0.001, 0.999))
    total = np.full(len(y), np.log(p / (1 - p)))
    nodes = 2 ** (DEPTH + 1) - 1
    feature, left, right = (np.zeros((TREES, nodes), np.int64) for _ in range(3))
    threshold, value = np.full((TREES, nodes), np.inf), np.zeros((TREES, nodes))
    left[:] = right[:] = np.arange(nodes)
    for t in range(TREES):
        now = 1 / (1 + np.exp(-total))
        slope, bend = y - now, now * (1 - now)
        members = {0: np.arange(len(y))}
        for node in range(nodes):
            rows = members.pop(node, None)
            if rows is None:
                continue
            g, h = slope[rows].sum(), bend[rows].sum()
            value[t, node] = RATE * g / (h + 1.0)
            best = (1e-6, -1, -1)
            if node < 2**DEPTH - 1 and len(rows) >= 2 * LEAST:
                for f, e in enumerate(edges):
                    b = binned[rows, f]
                    gs, hs, ns = (np.cumsum(np.bincount(b, weights=v, minlength=len(e) + 1))[:-1] for v in (slope[rows], bend[rows], np.ones(len(rows))))
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
            if best[1] >= 0:
                _, f, cut = best
                feature[t, node], threshold[t, node] = f, edges[f][cut]
                left[t, node], right[t, node] = 2 * node + 1, 2 * node + 2
                low = binned[rows, f] <= cut
                members[2 * node + 1], members[2 * node + 2] = rows[low], rows[~low]
            else:
                total[rows] += value[t, node]
    return Forest(feature, threshold, left, right, value, float(np.log(p / (1 - p))))


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"label": batch["label"], "order": batch["order"], "x": list(matrix(batch["words"]))})


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> Forest:
    """A forest for ``labels`` (doc_id, label 0 or 1) from up to ``max_rows`` of the labelled documents, those of least hash."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_doc")).agg((F.avg(label) >= 0.5).cast("double").alias("label"))
    chosen = written(known.orderBy(F.xxhash64("_doc"), "_doc").limit(max_rows), "labelled")
    rows = docs.select(F.col(doc_id).alias("_doc"), plain(text).alias("words")).join(chosen, "_doc")
    rows = rows.select("label", F.xxhash64("_doc", "words").alias("order"), "words").mapInPandas(_measured, "label double, order long, x array<double>")
    sample = rows.toPandas().sort_values("order", kind="stable")
    x = np.array(sample["x"].tolist(), np.float64).reshape(len(sample), len(FEATURES))
    return grow(x, sample["label"].to_numpy(np.float64))


def score(docs: DataFrame, forest: Forest, text: str = "text", column: str = "score") -> DataFrame:
    """Documents with their score from 0 to 1."""
    names = [c for c in docs.columns if c != column]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                x = matrix([t or "" for t in part.column(text).to_pylist()])
                made = pa.array(forest.score(x), pa.float64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], made], names=[*names, column])

    return docs.select(*names).mapInArrow(run, schema)
