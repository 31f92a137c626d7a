"""Benchmark decontamination by a prefix-filtered join of shingles.

A benchmark item has windows of ``WINDOW`` words (an item of fewer words is one
window). Both sides are cut into shingles of ``SHINGLE`` words (a window of fewer
words is one shingle of its own length). One pass over all documents keeps the
positions at which a benchmark shingle stands and so gives the shingles' corpus
counts. To contain a window, a text must contain its rarest shingle: that is the
necessary prefix of a window's shingles in order of rarity, and the only one that
is joined to find candidates. A candidate lies at the shingle's position less its
offset; it must begin in the text and end in it, and is verified by the exact words
of the shingles that cover the window, each at its place.

A shingle matches by hash and by its text. Where the benchmark's shingles are few
Spark broadcasts their table by its size; where they are many, both sides are
shuffled by hash.

Defined cases: null and empty texts have no words and are clean; an item without
words has no window; items with a null id are left out; documents are told apart by
id and text, so that rows of equal id each get their own counts; an empty benchmark
or an empty table is fine. Input columns with the names of added columns are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardgraph.llm.common import ascii_lower, plain, words, written

# Runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F]. With its members one by one the class is a
# table that the matcher looks up; as ranges it is several comparisons a character.
WORD = "[^" + "".join(f"\\x{c:02x}" for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)) for c in range(lo, hi + 1)) + "]+"
WINDOW, SHINGLE = 13, 5
# A document is contaminated if a twentieth of its words is hit.
ONE_IN = 20
OUTPUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _words(text) -> Column:
    return words(ascii_lower(plain(text)), WORD)


def _hash(w: Column, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from 0-based position ``at``."""
    return F.xxhash64(F.lit(size), *[F.get(w, at + k) for k in range(size)])


def _text(w: Column, at: Column, size: int) -> Column:
    return F.concat_ws(" ", *[F.get(w, at + k) for k in range(size)])


def item_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(item, window, words, len): each item's windows, told apart by their words."""
    items = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), _words(text).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, F.lit(window)).alias("words"))
    return cut.select("item", F.sha2(F.concat_ws(" ", "words"), 256).alias("window"), "words", F.size("words").alias("len")).distinct()


def _shingles(windows: DataFrame, size: int) -> DataFrame:
    """(window, len, of, offset, hash, shingle): all shingles of the windows of at least SHINGLE words, or of exactly ``size`` words below that."""
    fitting = windows.filter(F.col("len") >= size if size == SHINGLE else F.col("len") == size)
    at = F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("offset")
    return fitting.select("window", "len", "words", at).select(
        "window", "len", F.lit(size).alias("of"), "offset", _hash(F.col("words"), F.col("offset"), size).alias("hash"), _text(F.col("words"), F.col("offset"), size).alias("shingle")
    )


def _matches(docs: DataFrame, shingles: DataFrame, size: int) -> DataFrame:
    """(doc, body, n, pos, hash, shingle): where a shingle of the benchmark stands in a document."""
    hashes = written(shingles.filter(F.col("of") == size).select("hash").distinct(), "shingle-hashes")
    w = F.col("w")
    each = docs.select("doc", "body", "w", F.posexplode_outer("w").alias("pos", "word"))
    n = F.size(w)
    each = each.filter(F.col("pos") + size <= n).select("doc", "body", n.alias("n"), "pos", _hash(w, F.col("pos"), size).alias("hash"), _text(w, F.col("pos"), size).alias("shingle"))
    return each.join(hashes, "hash").select("doc", "body", "n", "pos", "hash", "shingle")


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(doc, body, start, len, window): every occurrence of a benchmark window in a document."""
    keyed = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(plain(text)).alias("body"), _words(text).alias("w"))
    windows = item_windows(benchmark, item_text, item_id, window).select("window", "words", "len").distinct()
    windows = written(windows, "windows")
    lengths = [r[0] for r in windows.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().orderBy("k").collect()]
    parts = [_shingles(windows, k) for k in lengths] or [_shingles(windows, SHINGLE)]
    shingles = parts[0]
    for part in parts[1:]:
        shingles = shingles.unionByName(part)
    shingles = written(shingles, "shingles")
    found = None
    for k in lengths or [SHINGLE]:
        one = _matches(keyed, shingles, k)
        found = one if found is None else found.unionByName(one)
    found = found.join(shingles.select("hash", "shingle").distinct(), ["hash", "shingle"]).select("doc", "body", "n", "pos", "hash")
    found = written(found, "matches")

    counts = found.groupBy("hash").agg(F.count("*").alias("n_corpus"))
    ranked = shingles.join(counts, "hash")
    rarest = ranked.groupBy("window", "len").agg(F.min(F.struct("n_corpus", "hash", "offset")).alias("r"), F.count("*").alias("there"), F.max("of").alias("of"))
    # A window that lacks one of its shingles in the whole corpus occurs nowhere.
    rarest = rarest.filter(F.col("there") == F.col("len") - F.col("of") + 1).select("window", "len", F.col("r.hash").alias("hash"), F.col("r.offset").alias("offset"))
    candidates = found.join(rarest, "hash").withColumn("start", F.col("pos") - F.col("offset"))
    candidates = candidates.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))).select("doc", "body", "start", "len", "window").distinct()
    # The shingles at every SHINGLE-th offset, and the last, cover a window.
    cover = shingles.filter((F.col("offset") % F.col("of") == 0) | (F.col("offset") == F.col("len") - F.col("of"))).select("window", "offset", "hash")
    needed = cover.groupBy("window").agg(F.count("*").alias("needed"))
    wanted = candidates.join(cover, "window").join(needed, "window").withColumn("pos", F.col("start") + F.col("offset"))
    same = [F.col("c.doc").eqNullSafe(F.col("f.doc")), F.col("c.body") == F.col("f.body"), F.col("c.pos") == F.col("f.pos"), F.col("c.hash") == F.col("f.hash")]
    verified = wanted.alias("c").join(found.alias("f"), same, "left_semi")
    return verified.groupBy("doc", "body", "start", "len", "window", "needed").agg(F.count("*").alias("got")).filter("got = needed").select("doc", "body", "start", "len", "window")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """All documents with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` (n_hit > 0 and one_in * n_hit >= n_words)."""
    found = written(hits(docs, benchmark, text, doc_id, item_text, item_id, window), "hits")
    # Runs of covered words: what a window adds beyond the furthest end before it.
    order = Window.partitionBy("doc", "body").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc", "body", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    covered = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(order), F.lit(0)))).withColumn("more", F.greatest(F.col("end") - F.col("from"), F.lit(0)))
    covered = covered.groupBy("doc", "body").agg(F.sum("more").alias("_hit_n"))
    items = item_windows(benchmark, item_text, item_id, window).select("item", "window")
    named = found.select("doc", "body", "window").distinct().join(items, "window").groupBy("doc", "body").agg(F.collect_set("item").alias("_hit_items"))
    both = covered.join(named, [covered["doc"].eqNullSafe(named["doc"]), covered["body"] == named["body"]])
    both = written(both.select(covered["doc"].alias("_hit_doc"), covered["body"].alias("_hit_body"), "_hit_n", "_hit_items"), "hit-docs")
    names = [c for c in docs.columns if c not in OUTPUT]
    keyed = docs.select(*names).withColumn("_own_body", F.xxhash64(plain(text)))
    joined = keyed.join(both, F.col(doc_id).eqNullSafe(F.col("_hit_doc")) & (F.col("_own_body") == F.col("_hit_body")), "left")
    n, hit = F.size(_words(text)).cast("long"), F.coalesce("_hit_n", F.lit(0)).cast("long")
    ids = F.coalesce("_hit_items", F.array().cast("array<string>"))
    return (
        joined.select(*names, n.alias("n_words"), hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))
    )
