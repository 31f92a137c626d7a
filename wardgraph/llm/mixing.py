"""Mixing sources to target weights by weighted random order (Efraimidis and Spirakis).

Every document draws an exponential key, ``-ln(u) / weight``, from a hash of its
id; within a source the documents are ordered by key and their sizes summed up
until the source's budget of words is met. A source whose target exceeds its
size gives whole epochs first and the rest as a selection.

No source is sorted as a whole. Keys fall into 1,024 ordered slices; sums per
source and slice say in which slice the budget ends, and only the documents of
that slice are ordered and summed one by one. What goes back to the documents is
one row per source: its target, its epochs and the key at which it is cut.

Defined cases: a null text has size 0; null is a source of its own, after all
others; a null or non-positive quality weight counts as 1; a null id hashes as the
empty text; rows of equal id in a source are one unit, taken or left together;
an empty table gives an empty table. An input column that has the name of an
output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgraph.llm.common import n_words, written

SLICES = 1024
CYCLE = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
OUTPUT = ["size", "source_size", "target", "taken", "copies"]


def _source_key(source: Column) -> Column:
    """A key that is never null and keeps code-point order, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def source_targets(sources: DataFrame, share: float = 1.0, max_epochs: int = MAX_EPOCHS, weights: DataFrame | None = None) -> DataFrame:
    """Targets of sources ``(source_key, source_size)``, one row per source.

    Sources in code-point order, null last, weigh 1, 2, 3 in turn unless
    ``weights`` (source, weight) names others; a source that it leaves out
    weighs 0. The targets share ``share`` of all words by weight; a target stops
    at ``max_epochs`` times its source and the excess goes to the others by
    weight. That is the level L with sum(min(cap, L * weight)) = total; with the
    sources ordered by cap / weight, L is the greatest of the levels that remain when
    the first k sources are held at their cap.
    """
    if weights is None:
        place = F.row_number().over(Window.orderBy("source_key")) - 1
        turns = F.array(*[F.lit(w) for w in CYCLE])
        weighed = sources.withColumn("weight", F.get(turns, place % len(CYCLE)))
    else:
        named = weights.select(_source_key(F.col("source")).alias("source_key"), F.col("weight").cast("double").alias("weight"))
        weighed = sources.join(named, "source_key", "left").fillna(0.0, ["weight"])
    size = F.col("source_size").cast("double")
    weighed = weighed.withColumn("cap", size * max_epochs).withColumn("ratio", F.when(F.col("weight") > 0, F.try_divide("cap", "weight")).otherwise(F.lit(float("inf"))))
    order = Window.orderBy("ratio", "source_key")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.withColumn("total", F.sum(size).over(everything) * share).withColumn("level", F.try_divide(F.col("total") - before, rest))
    return levels.withColumn("level", F.max("level").over(everything)).select(
        "source_key", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.lit(0.0)).alias("target")
    )


def _keyed(docs: DataFrame, doc_id: str, source: str, quality: Column | None, seed: str) -> DataFrame:
    """Documents with unit id, source key, exponential key and slice under names of their own."""
    weight = F.lit(1.0) if quality is None else F.when(quality > 0, quality.cast("double")).otherwise(F.lit(1.0))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_mix_id"))), 1, 13), 16, 10).cast("double")
    return (
        docs.withColumn("_mix_id", F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
        .withColumn("_mix_source", _source_key(F.col(source)))
        .withColumn("_mix_key", -F.log((drawn + 0.5) / float(16**13)) / weight)
        .withColumn("_mix_slice", F.least(F.floor((1 - F.exp(-F.col("_mix_key"))) * SLICES), F.lit(SLICES - 1)).cast("int"))
    )


def _size(text: str, size: Column | None) -> Column:
    return n_words(F.col(text)) if size is None else F.coalesce(size, F.lit(0)).cast("long")


def plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", quality: Column | None = None, size: Column | None = None, seed: str = "mix", share: float = 1.0, max_epochs: int = MAX_EPOCHS, weights: DataFrame | None = None) -> DataFrame:
    """One row per source: size, target, whole epochs and the place where its last epoch is cut.

    The number of sources is that of the mix's weights, so one task orders them.
    """
    units = written(
        _keyed(docs, doc_id, source, quality, seed).select("_mix_source", "_mix_slice", "_mix_key", "_mix_id", _size(text, size).alias("n")),
        "mix-units",
    )
    slices = units.groupBy("_mix_source", "_mix_slice").agg(F.sum("n").alias("n"))
    sources = slices.groupBy(F.col("_mix_source").alias("source_key")).agg(F.sum("n").alias("source_size"))
    whole = F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")))
    targets = source_targets(sources, share, max_epochs, weights).withColumn("epochs", F.coalesce(whole, F.lit(0)).cast("long"))
    targets = targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    in_order = Window.partitionBy("_mix_source").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        slices.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
        .join(targets, F.col("_mix_source") == F.col("source_key"))
        .filter(F.col("before") <= F.col("budget"))
        .groupBy("_mix_source", "source_size", "target", "epochs", "budget")
        .agg(F.max_by(F.struct("_mix_slice", "before"), "_mix_slice").alias("last"))
        .select("_mix_source", "source_size", "target", "epochs", "budget", F.col("last._mix_slice").alias("_mix_slice"), F.col("last.before").alias("before"))
    )
    cuts = written(cuts, "mix-cuts")
    within = Window.partitionBy("_mix_source").orderBy("_mix_key", "_mix_id").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        units.join(cuts.select("_mix_source", "_mix_slice", "before", "budget"), ["_mix_source", "_mix_slice"])
        .groupBy("_mix_source", "_mix_key", "_mix_id", "before", "budget")
        .agg(F.sum("n").alias("n"))
        .withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
        .filter(F.col("before") + F.col("n") / 2 <= F.col("budget"))
        .filter(F.col("budget") > 0)
        .groupBy("_mix_source")
        .agg(F.max(F.struct("_mix_key", "_mix_id")).alias("cut"))
    )
    return written(cuts.drop("before").withColumnRenamed("_mix_slice", "cut_slice").join(last, "_mix_source", "left"), "mix-plan")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", quality: Column | None = None, size: Column | None = None, seed: str = "mix", share: float = 1.0, max_epochs: int = MAX_EPOCHS, weights: DataFrame | None = None) -> DataFrame:
    """All documents with ``size``, ``source_size``, ``target``, ``copies`` (how often the mix takes it) and ``taken`` words.

    ``quality`` scales a document's chance to be selected; ``size`` says its words
    where they were counted before. The document at the cut
    is taken if that brings the source nearer to its target, so a source misses
    its target by half a document at most. A run repeated on the same rows takes
    the same documents.
    """
    cuts = plan(docs, text, doc_id, source, quality, size, seed, share, max_epochs, weights)
    keyed = _keyed(docs, doc_id, source, quality, seed)
    cuts = cuts.select("_mix_source", F.col("source_size").alias("_mix_total"), F.col("target").alias("_mix_target"), "epochs", "budget", "cut_slice", "cut")
    joined = keyed.join(cuts.select(*[F.col(c).alias(c if c.startswith("_mix") else f"_mix_{c}") for c in cuts.columns]), "_mix_source", "left")
    here = F.col("_mix_slice") == F.col("_mix_cut_slice")
    selected = (F.col("_mix_budget") > 0) & ((F.col("_mix_slice") < F.col("_mix_cut_slice")) | (here & (F.struct("_mix_key", "_mix_id") <= F.col("_mix_cut"))))
    copies = F.col("_mix_epochs") + F.when(selected, 1).otherwise(0)
    kept = [c for c in docs.columns if c not in OUTPUT]
    words = F.col("_mix_size")
    return joined.withColumn("_mix_size", _size(text, size)).select(
        *kept, words.alias("size"), F.col("_mix_total").cast("long").alias("source_size"), F.col("_mix_target").alias("target"), (words * copies).cast("long").alias("taken"), copies.cast("long").alias("copies")
    )
