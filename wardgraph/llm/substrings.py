"""Substring dedup by level-wise doubling over words.

Documents that are copies of a whole earlier text are told by its digest; all their
windows repeat. Among the others, level 1 takes windows of half the asked length (7 for 13). Of the half windows
inside a full window the one of least hash stands for it, so equal full windows
have equal stand-ins and a quarter of all positions is enough: stand-ins that occur
in one document alone end there. Level 2 hashes full windows (128 bits) only where
the stand-in repeats, and again those of one document alone end. ``repeated_spans``
goes on to twice, four times ... the length: a window of 2L is a candidate if both
its halves repeat at L, until no candidates survive.

A word is removed if a window that covers it also starts in a document with a
smaller id; what is judged is the input, not what other removals leave.

Defined cases: null and empty texts have no words; documents with fewer words than
the window have no windows; documents with a null id are neither changed nor
compared; rows of equal id don't count as repeats of each other; an empty table
gives an empty table. Input columns with the names of added columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgraph.llm.common import counted, plain, written
from wardgraph.llm.hashing import M1, M2, WordHashes, chunks, windows

WINDOW = 13


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` values in a row."""
    width = 1
    while width < size:
        step = min(width, size - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


def _standins(hashes: np.ndarray, ends: np.ndarray, window: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of ``hashes`` up to ``ends``: hash of each stand-in, the first full window it stands for, and how many in a row."""
    least = _least(windows(hashes, half), window - half + 1)
    inside = np.zeros(len(least) + 1, bool)
    for lo, hi in zip(np.r_[0, ends[:-1]], ends):
        inside[lo : max(lo, hi - window + 1)] = True
    first = np.zeros(len(least), bool)
    first[0] = True
    first[1:] = least[1:] != least[:-1]
    first[1:] |= ~inside[:-2]
    starts = np.flatnonzero(first & inside[:-1])
    # A run ends at the next start or where windows leave the document.
    stops = np.flatnonzero(np.r_[first, True] | ~inside)
    until = stops[np.searchsorted(stops, starts, side="right")]
    return least[starts], starts, until - starts


def _words_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _level_one(window: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts = _words_of(batch, "words")
            for part in chunks([len(x) // 6 for x in texts]):
                rows, own = [], []
                for i in part:
                    words = texts[i].split()
                    if len(words) >= window:
                        rows.append(i)
                        own.append(known.of(words))
                if not rows:
                    continue
                ends = np.cumsum([len(x) for x in own])
                hashes, starts, counts = _standins(np.concatenate(own), ends, window, half)
                of = np.searchsorted(ends, starts, side="right")
                at = pa.array(np.array(rows)[of])
                starts = starts - np.r_[0, ends[:-1]][of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), batch.column("doc").take(at), batch.column("body").take(at), pa.array(starts.astype(np.int32)), pa.array(counts.astype(np.int32))], names=["standin", "doc", "body", "lo", "n"]
                )

    return run


def _level_two(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts, spans = _words_of(batch, "words"), batch.column("spans")
            for part in chunks([len(x) // 6 for x in texts]):
                own = [known.of(texts[i].split()) for i in part]
                begins = np.r_[0, np.cumsum([len(x) for x in own])]
                span = spans.slice(part.start, len(part))
                row = np.repeat(np.arange(len(part)), pa.compute.list_value_length(span).to_numpy())
                lo, n = span.flatten().field("lo").to_numpy(), span.flatten().field("n").to_numpy()
                row, lo = np.repeat(row, n), np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                hashes = np.concatenate(own)
                at = pa.array(row + part.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(windows(hashes, window, f)[begins[row] + lo].view(np.int64)) for f in (M1, M2)] + [batch.column("doc").take(at), batch.column("body").take(at), pa.array(lo.astype(np.int32))],
                    names=["k1", "k2", "doc", "body", "pos"],
                )

    return run


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc"), F.xxhash64(plain(text)).alias("body"), plain(text).alias("words")).filter("doc IS NOT NULL")


def copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, body): documents whose whole text a document with a smaller id has. All their windows repeat, so only the first of equal texts goes on."""
    texts = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(plain(text)).alias("body"), F.md5(plain(text)).alias("whole")).filter("doc IS NOT NULL")
    texts = written(texts, "texts")
    # Written, so that Spark can split the join where one text has many copies.
    firsts = written(texts.groupBy("body", "whole").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last"), "first-texts")
    return written(texts.join(firsts, ["body", "whole"]).filter("doc > first").select("doc", "body").distinct(), "copies")


def _repeats(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur in more than one document, with the smallest id."""
    return rows.groupBy(*key).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")


def repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, but: DataFrame | None = None) -> DataFrame:
    """(k1, k2, doc, body, pos, first): each occurrence of a window of ``window`` words that stands in several documents; ``first`` is the smallest id. The documents of ``but`` (doc, body) are left out."""
    half = (window + 1) // 2
    keyed = _keyed(docs, text, doc_id)
    if but is not None:
        keyed = keyed.join(counted(but), ["doc", "body"], "left_anti")
    id_type = keyed.schema["doc"].dataType
    row = [T.StructField("doc", id_type), T.StructField("body", T.LongType())]
    ones = keyed.mapInArrow(_level_one(window, half), T.StructType([T.StructField("standin", T.LongType()), *row, T.StructField("lo", T.IntegerType()), T.StructField("n", T.IntegerType())]))
    ones = written(ones, "ones")
    standins = written(_repeats(ones.select("standin", "doc"), "standin").select("standin"), "standins")
    spans = written(ones.join(standins, "standin", "left_semi").groupBy("doc", "body").agg(F.collect_list(F.struct("lo", "n")).alias("spans")), "spans")
    candidates = keyed.join(counted(spans.select("doc", "body")), ["doc", "body"], "left_semi").join(spans, ["doc", "body"])
    twos = written(
        candidates.select("doc", "body", "words", "spans").mapInArrow(_level_two(window), T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), *row, T.StructField("pos", T.IntegerType())])),
        "windows",
    )
    return twos.join(written(_repeats(twos, "k1", "k2"), "repeats"), ["k1", "k2"])


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(doc, body, pos, length, first): each repeated window that is part of no longer one, by doubling from ``window`` on until no candidates survive."""
    level, length = written(repeated_windows(docs, text, doc_id, window), "level"), window
    done = None
    while level.head(1):
        left, right = level.alias("a"), level.alias("b")
        same = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.body") == F.col("b.body")) & (F.col("a.pos") + length == F.col("b.pos"))
        pairs = left.join(right, same).select(
            F.xxhash64("a.k1", "b.k1").alias("k1"), F.xxhash64(F.lit(1), "a.k2", "b.k2").alias("k2"), F.col("a.doc").alias("doc"), F.col("a.body").alias("body"), F.col("a.pos").alias("pos")
        )
        pairs = written(pairs, "pairs")
        longer = written(pairs.join(_repeats(pairs, "k1", "k2"), ["k1", "k2"]), "level")
        # A window ends here unless a longer one begins up to ``length`` words before it.
        before = F.max(F.when(F.col("longer"), F.col("pos"))).over(Window.partitionBy("doc", "body").orderBy("pos"))
        both = level.select("doc", "body", "pos", "first", F.lit(False).alias("longer")).unionByName(longer.select("doc", "body", "pos", "first", F.lit(True).alias("longer")))
        ends = both.withColumn("before", before).filter(~F.col("longer") & (F.col("before").isNull() | (F.col("before") < F.col("pos") - length)))
        ends = ends.select("doc", "body", "pos", F.lit(length).alias("length"), "first")
        done = ends if done is None else done.unionByName(ends)
        level, length = longer, 2 * length
    return done if done is not None else level.select("doc", "body", "pos", F.lit(length).alias("length"), "first")


def _cut(window: int, schema: T.StructType):
    """Drops the covered words; ``_sub_starts`` has the removed windows of a row, ``_sub_copy`` says that all are."""
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, whole = _words_of(batch, "_sub_text"), batch.column("_sub_starts"), batch.column("_sub_copy").to_pylist()
            for part in chunks([len(x) // 6 for x in texts]):
                kept, n_words, n_removed = [], [], []
                for i in part:
                    words = texts[i].split()
                    n = len(words)
                    if whole[i] and n >= window:
                        words = []
                    elif starts[i].is_valid:
                        at = starts[i].values.to_numpy()
                        edges = np.zeros(n + 1, np.int32)
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + window, -1)
                        words = [words[j] for j in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                    kept.append(b" ".join(words))
                    n_words.append(n)
                    n_removed.append(n - len(words))
                made = {"_sub_kept": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
                piece = batch.slice(part.start, len(part))
                yield pa.RecordBatch.from_arrays([made[c] if c in made else piece.column(c) for c in names], names=names)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Documents with the words kept, joined by one space, as their text, and ``n_words`` and ``n_removed``."""
    whole = copies(docs, text, doc_id)
    occurrences = repeated_windows(docs, text, doc_id, window, but=whole).filter("doc > first")
    removed = written(occurrences.groupBy(F.col("doc").alias("_sub_doc"), F.col("body").alias("_sub_body")).agg(F.collect_set("pos").alias("_sub_starts")), "removed")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    # The text itself comes back as the words kept, so only one text travels.
    keyed = docs.select(*[plain(text).alias("_sub_text") if c == text else F.col(c) for c in names]).withColumn("_sub_own", F.xxhash64("_sub_text"))
    out = [c if c != text else "_sub_text" for c in names]

    def those(rows: DataFrame, how: str, of: DataFrame) -> DataFrame:
        return of.join(rows, (F.col(doc_id) == F.col("_sub_doc")) & (F.col("_sub_own") == F.col("_sub_body")), how)

    copied = counted(whole.select(F.col("doc").alias("_sub_doc"), F.col("body").alias("_sub_body")))
    touched = counted(removed.select("_sub_doc", "_sub_body"))
    none, false = F.lit(None).cast("array<int>").alias("_sub_starts"), F.lit(False).alias("_sub_copy")
    rest = those(copied, "left_anti", keyed)
    parts = [
        those(copied, "left_semi", keyed).select(*out, none, F.lit(True).alias("_sub_copy")),
        those(removed, "inner", those(touched, "left_semi", rest)).select(*out, "_sub_starts", false),
        those(touched, "left_anti", rest).select(*out, none, false),
    ]
    schema = T.StructType([T.StructField("_sub_kept", T.StringType()) if c == text else docs.schema[c] for c in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    cut = parts[0].unionByName(parts[1]).unionByName(parts[2]).mapInArrow(_cut(window, schema), schema)
    return cut.withColumnRenamed("_sub_kept", text)
