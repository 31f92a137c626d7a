"""Line dedup by spread over sites: lines that stand on many sites are boilerplate.

One aggregation over all lines merges, per line hash, a HyperLogLog sketch of the
sites and one of the texts that hold the line. Lines whose estimates are clearly
over both thresholds are boilerplate, those clearly under one are not; the lines
in between are counted exactly. A spread line is removed from every document but
the one with the smallest id that holds it, so no line leaves the corpus. Copies
of one text count as one text, so that a copied document is not taken for
boilerplate (finding copies is the task of near-duplicate detection).

With ``site_share`` the thresholds follow the corpus: a line is then boilerplate on
that share of the sites that have lines (never under ``FEW_SITES``, and ``min_sites``
always suffice), and needs no more texts than sites where at least ``OWN_TEXTS`` of
the documents that hold it differ, so that copies are not why it is spread; else it
needs ``min_texts``. On fewer than ``FEW_SITES`` sites no line is spread.

Lines are what stands between ``\\n``; blank lines are never boilerplate and are
kept. Lines are told apart by 64-bit hashes.

Defined cases: a null text has no lines and stays null; null is a site of its own;
documents without id never count as the first; rows of equal id are one document;
an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgraph.llm.common import LINE_WORD, small, written

MIN_SITES = 12
MIN_TEXTS = 12
# For thresholds that follow the number of sites: 6 of 20 sites.
SITE_SHARE, FEW_SITES, OWN_TEXTS = 0.3, 3, 0.75
# Registers 2**LG_K: standard error 1.04 / sqrt(2**LG_K), here 3.3 %. Estimates
# within BAND of a threshold, over four standard errors, are counted exactly.
LG_K = 10
BAND = 0.14


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _lines(docs: DataFrame, text: str, doc_id: str, site: str) -> DataFrame:
    """(line, site, body, doc): hashes of all lines that are not blank, with site, text hash and id."""
    slim = docs.select(
        F.col(doc_id).alias("doc"),
        F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n"))).alias("site"),
        F.xxhash64(text).alias("body"),
        F.explode_outer(_split(F.col(text))).alias("words"),
    )
    return slim.filter(F.col("words").rlike(LINE_WORD)).select(F.xxhash64("words").alias("line"), "site", "body", "doc")


def least_sites(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, site_share: float = SITE_SHARE) -> int:
    """On how many sites a line is spread, by the number of sites that have lines."""
    sites = docs.filter(F.col(text).rlike(LINE_WORD)).select(F.col(site).cast("string")).distinct().count()
    return min(min_sites, max(FEW_SITES, math.ceil(site_share * sites - 1e-9)))


def spread_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", site: str = "source", min_sites: int = MIN_SITES, min_texts: int = MIN_TEXTS, site_share: float | None = None) -> DataFrame:
    """(line, first): hash of each line on at least ``min_sites`` sites and in ``min_texts`` different texts, or on ``site_share`` of the sites, and the smallest id that holds it."""
    lines = _lines(docs, text, doc_id, site)
    follows = site_share is not None
    if follows:
        min_sites = least_sites(docs, text, site, min_sites, site_share)
    few_texts = min(min_sites, min_texts)
    if follows:
        # Rows without id are told by their texts.
        lines = lines.withColumn("holder", F.when(F.col("doc").isNull(), F.col("body")).otherwise(F.xxhash64(F.col("doc").cast("string"))))
    made = {"sites": "site", "texts": "body"} | ({"docs": "holder"} if follows else {})

    def many(by: float, ratio: float) -> Column:
        """Whether the counts, times ``by`` at least, are over the thresholds."""
        texts = F.col("texts") >= min_texts * by
        if follows:
            texts |= (F.col("texts") >= few_texts * by) & (F.col("texts") >= OWN_TEXTS * ratio * F.col("docs"))
        return (F.col("sites") >= min_sites * by) & texts

    sketched = lines.groupBy("line").agg(F.min("doc").alias("first"), *[F.hll_sketch_agg(c, LG_K).alias(k) for k, c in made.items()])
    over = sketched.select("line", "first", *[F.hll_sketch_estimate(k).alias(k) for k in made]).filter(many(1 - BAND, (1 - BAND) / (1 + BAND)))
    over = written(over.withColumn("sure", many(1 + BAND, (1 + BAND) / (1 - BAND))), "spread-lines")
    near = over.filter(~F.col("sure")).select("line", "first")
    exact = lines.join(near, "line").groupBy("line", "first").agg(*[F.count_distinct(c).alias(k) for k, c in made.items()]).filter(many(1, 1))
    return written(over.filter("sure").select("line", "first").unionByName(exact.select("line", "first")), "boilerplate")


def remove_spread_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", site: str = "source", min_sites: int = MIN_SITES, min_texts: int = MIN_TEXTS, counts: bool = False, site_share: float | None = None) -> DataFrame:
    """Documents with the spread lines cut from their texts; ``counts`` adds ``n_lines`` and ``n_removed``."""
    spread = spread_lines(docs, text, doc_id, site, min_sites, min_texts, site_share)
    pairs = (
        _lines(docs, text, doc_id, site)
        .join(spread, "line")
        .filter(F.col("doc").isNull() | F.col("first").isNull() | (F.col("doc") > F.col("first")))
        .select(F.col("doc").alias("_hit_doc"), "line")
        .distinct()
    )
    pairs = written(pairs, "line-hits")
    hits = pairs.groupBy("_hit_doc").agg(F.collect_set("line").alias("_hit_lines"))
    # Grouped rows hold no more than the pairs they are made of.
    hits = F.broadcast(hits) if small(pairs) else hits
    joined = docs.join(hits, F.col(doc_id).eqNullSafe(F.col("_hit_doc")), "left")
    joined = joined.withColumn("_lines", _split(F.col(text)))
    kept = F.filter("_lines", lambda x: ~F.array_contains("_hit_lines", F.xxhash64(x)) | ~x.rlike(LINE_WORD))
    joined = joined.withColumn("_kept", F.when(F.col("_hit_lines").isNull(), F.col("_lines")).otherwise(kept))
    out = [F.when(F.col("_hit_lines").isNull(), F.col(c)).otherwise(F.array_join("_kept", "\n")).alias(c) if c == text else F.col(c) for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    if counts:
        n = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long")
        left = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_kept")).cast("long")
        out += [n.alias("n_lines"), (n - left).alias("n_removed")]
    return joined.select(*out)
