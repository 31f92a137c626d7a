"""Near-duplicate detection by MinHash with tensored banding.

A table key of ordinary banding joins ``2 * ROWS`` minhash values, and each of L
tables needs values of its own. Here two collections, A and B, hold ``HALVES``
half keys of ``ROWS`` values each, and the table keys are all pairs (A_i, B_j):
HALVES**2 tables from 2 * HALVES half keys. Documents of similarity s meet in some
table with probability (1 - (1 - s**ROWS)**HALVES)**2: with 4 rows and 20 halves,
0.99995 at s = 0.8 and 0.9999999 at s = 0.86, from 160 values instead of 3,200.

Only half keys that occur in two documents can lead to a shared table key, so the
others are left out before pairs of halves are formed. Documents of equal sets are
one class throughout, whatever their number. Candidates whose signatures agree in
fewer than half of the values are left out: for a pair at s = 0.8 that happens with
a probability under 1e-15. All others are verified on their full sets.

The members of a table key (a bucket) are joined by stars (``linking``), which is
linear in the members. Where a bucket then still holds several components, its members
are joined by their rarest shingles (a prefix filter, exact at the threshold), each
shingle's minor components against the others. So no bucket emits its pairs, and none
is capped; the way is the same whatever a bucket's size.

Defined cases: null and empty texts have an empty set and link with nothing; a
document with fewer words than the shingle has its whole sequence as its set; rows
with a null id stand alone (component null, kept); rows of equal id are told apart by
their texts, each with the component of its own text; an empty table gives an empty
table. Input columns with the names of added columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgraph.llm.common import ascii_lower, counted, plain, written
from wardgraph.llm.hashing import M2, WordHashes, mixed, windows
from wardgraph.llm.linking import components, grow_halving as grow, placed

ROWS, HALVES = 4, 20
# Longs of a set's bitmap; where two bitmaps differ, the sets do.
BITMAP = 32
SHINGLE, PERCENT = 2, 80
OUTPUT = ["n_shingles", "component_id", "kept"]

_VALUES = 2 * HALVES * ROWS
_SEEDS = mixed(np.arange(1, _VALUES + 1, dtype=np.uint64) * M2) | np.uint64(1)

SIGNATURES = [
    T.StructField("body", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("same", T.BinaryType()),
    T.StructField("halves", T.ArrayType(T.LongType(), False)),
    T.StructField("signature", T.ArrayType(T.ByteType(), False)),
]


def shingles(words: list[bytes], known: WordHashes, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of a document's shingles, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(known.of(words), min(size, len(words))))


def minhashes(shingle_hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    least = np.full(_VALUES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingle_hashes), 256):
        values = shingle_hashes[start : start + 256, None] * _SEEDS
        values ^= values >> np.uint64(32)
        values *= M2
        np.minimum(least, values.min(axis=0), out=least)
    return least


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts = batch.column("words")
            for start in range(0, batch.num_rows, 2000):
                rows = range(start, min(start + 2000, batch.num_rows))
                counts, same, halves, signatures = [], [], [], []
                for i in rows:
                    own = shingles(texts[i].as_py().encode().split(), known, size)
                    counts.append(len(own))
                    same.append(blake2b(own.tobytes(), digest_size=16).digest())
                    least = mixed(minhashes(own)) if len(own) else np.zeros(_VALUES, np.uint64)
                    halves.append(windows_of(least.reshape(2 * HALVES, ROWS)))
                    signatures.append((least >> np.uint64(11)).astype(np.uint8))
                values, bytes_ = np.concatenate(halves), np.concatenate(signatures)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(start, len(rows)),
                        batch.column("body").slice(start, len(rows)),
                        pa.array(counts, pa.int64()),
                        pa.array(same, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, 2 * HALVES, dtype=np.int32)), pa.array(values.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(bytes_) + 1, _VALUES, dtype=np.int32)), pa.array(bytes_.view(np.int8))),
                    ],
                    names=["doc", "body", "n", "same", "halves", "signature"],
                )

    return run


def windows_of(groups: np.ndarray) -> np.ndarray:
    """One hash per row of minhash values."""
    out = np.zeros(len(groups), np.uint64)
    for k in range(groups.shape[1]):
        out = out * M2 + groups[:, k]
    return mixed(out)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts = batch.column("words")
            for start in range(0, batch.num_rows, 1000):
                rows = range(start, min(start + 1000, batch.num_rows))
                own = [shingles(texts[i].as_py().encode().split(), known, size) for i in rows]
                ends = np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int32)
                bits = np.zeros((len(own), 64 * BITMAP), bool)
                for k, x in enumerate(own):
                    bits[k, x % np.uint64(64 * BITMAP)] = True
                maps = np.packbits(bits, axis=1).view(np.int64).ravel()
                at = pa.array(np.arange(0, len(maps) + 1, BITMAP, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class").slice(start, len(rows)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64))), pa.ListArray.from_arrays(at, pa.array(maps))],
                    names=["class", "set", "bits"],
                )

    return run


def _agreement(a: str, b: str):
    """Equal values of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _candidate_sets(buckets: DataFrame, heads: DataFrame, keyed: DataFrame, size: int) -> DataFrame:
    """(class, set, bits) of the classes in buckets, from their whole texts: the full set and a bitmap of its members.

    Written once; every check of pairs reads it instead of the texts.
    """
    candidates = written(buckets.select("class").distinct(), "candidates")
    ids = written(heads.join(counted(candidates), "class", "left_semi").select("doc", "body", "class"), "candidate-ids")
    words = keyed.join(counted(ids), ["doc", "body"]).select("class", "words")
    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType([T.StructField("class", T.LongType()), T.StructField("set", longs), T.StructField("bits", longs)])
    return written(words.mapInArrow(_sets(size), schema).dropDuplicates(["class"]), "sets")


class _Links:
    """What is known of the classes, and the check of pairs on full sets."""

    def __init__(self, heads: DataFrame, sets: DataFrame, percent: int):
        self.heads, self.sets, self.percent = heads, sets, percent

    def of(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of pairs (a, b)."""
        sides = [self.heads.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}")) for s in "ab"]
        near = pairs.join(sides[0], "a").join(sides[1], "b").filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        near = written(near.filter(2 * _agreement("s_a", "s_b") >= _VALUES).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n")), "near-pairs")
        ends = written(near.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "pair-ends")
        sets = self.sets.select("class", "set").join(counted(ends), "class", "left_semi")
        # A head has many partners: its set comes last, so that it is not carried with each.
        often = [near.groupBy(s).agg(F.count("*").alias(f"k_{s}")) for s in "ab"]
        a_heads = F.col("k_a") >= F.col("k_b")
        turned = near.join(often[0], "a").join(often[1], "b").select("a", "b", "n", F.when(a_heads, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(a_heads, F.col("b")).otherwise(F.col("a")).alias("y"))
        both = written(turned, "turned").join(sets.select(F.col("class").alias("y"), F.col("set").alias("set_y")), "y").join(sets.select(F.col("class").alias("x"), F.col("set").alias("set_x")), "x")
        common = F.size(F.array_intersect("set_x", "set_y"))
        return both.filter(100 * common >= self.percent * (F.col("n") - common)).select("a", "b")


def _rare_pairs(crowd: DataFrame, links: _Links) -> DataFrame:
    """All pairs (a, b) of a crowd (class, component) that can be linked and lie in different components.

    Sets of similarity s share one of their n - ceil(s n) + 1 rarest shingles, in
    any order that holds for all. A shingle's members are compared only with those
    outside the component that has most of them, and only if neither the shingles
    they share with the crowd, nor the places of the shingle in both, nor their
    bitmaps rule a link out.
    """
    percent = links.percent
    sets = written(links.sets.join(counted(crowd), "class"), "crowd-sets")
    each = written(sets.select("class", "component", F.size("set").alias("n"), F.explode("set").alias("shingle")), "crowd-shingles")
    counts = each.groupBy("shingle").agg(F.count("*").alias("k"))
    # A shingle that only one member has links nobody, but fills its place; those
    # that others have too (``shared``) bound what two sets can have in common.
    place = F.row_number().over(Window.partitionBy("class").orderBy("k", "shingle"))
    shared = F.count(F.when(F.col("k") > 1, 1)).over(Window.partitionBy("class"))
    first = each.join(written(counts, "shingle-counts"), "shingle").withColumn("place", place).withColumn("shared", shared)
    first = written(first.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).filter("k > 1").select("shingle", "class", "component", "n", "shared", "place"), "prefixes")
    first = first.join(sets.select("class", "bits"), "class")
    most = first.groupBy("shingle", "component").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("most"), F.count("*").alias("parts"))
    minor = first.join(most.filter("parts > 1"), "shingle").filter("component <> most").select("shingle", F.col("class").alias("x"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("shared").alias("x_shared"), F.col("place").alias("x_place"), F.col("bits").alias("x_bits"))
    most_common = F.least("shared", "x_shared")
    can_link = 100 * most_common >= percent * (F.col("n") + F.col("m") - most_common)
    # At the first shingle that two sets share no more than those after it can follow.
    can_link = can_link & ((100 + percent) * (1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("x_place"))) >= percent * (F.col("n") + F.col("m")))
    apart = F.aggregate(F.zip_with("bits", "x_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    can_link = can_link & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m")))
    pairs = minor.join(first, (minor["shingle"] == first["shingle"]) & (F.col("c") != F.col("component")) & can_link)
    return pairs.select(F.least("x", "class").alias("a"), F.greatest("x", "class").alias("b")).distinct()


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc, body, n, part, component): of each text the size of its set, a number of its component and the smallest id reachable by links; ``body`` is the text's hash."""
    keyed = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(plain(text)).alias("body"), ascii_lower(plain(text)).alias("words")).filter("doc IS NOT NULL")
    signed = keyed.mapInArrow(_signed(size), T.StructType([keyed.schema["doc"], *SIGNATURES]))
    units = written(signed.withColumn("class", F.monotonically_increasing_id()), "signatures")
    filled = units.filter("n > 0")
    groups = filled.groupBy("n", "same").agg(F.min("class").alias("first"), F.count("*").alias("k")).filter("k > 1").select("n", "same", "first")
    # Written, so that Spark can split the join where one set has many copies.
    copies = written(filled.select("n", "same", "class").join(written(groups, "groups"), ["n", "same"]).filter("class <> first").select("class", "first"), "copies")
    heads = filled.join(counted(copies.select("class")), "class", "left_anti")

    half = heads.select("class", F.posexplode("halves").alias("slot", "half")).withColumn("half", F.xxhash64("slot", "half"))
    shared = half.groupBy("half").agg(F.count("*").alias("k")).filter("k > 1").select("half")
    live = half.join(shared, "half").groupBy("class").agg(F.collect_list(F.when(F.col("slot") < HALVES, F.col("half"))).alias("a"), F.collect_list(F.when(F.col("slot") >= HALVES, F.col("half"))).alias("b"))
    live = live.withColumn("rank", F.size("a") * F.size("b"))
    tables = live.select("class", "rank", F.explode("a").alias("a"), "b").select("class", "rank", "a", F.explode("b").alias("b")).select("class", "rank", F.xxhash64("a", "b").alias("key"))
    tables = written(tables, "tables")
    met = tables.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    buckets = written(tables.join(written(met, "met"), "key"), "buckets")

    links = _Links(heads, _candidate_sets(buckets, heads, keyed, size), percent)
    joined, crowd = grow(buckets, links.of)
    if crowd.head(1):
        found = links.of(written(_rare_pairs(crowd, links), "rare-pairs"))
        joined = components(found.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    # Classes are numbers of rows; a component is told by its smallest id.
    member = units.select("class", "doc", "body", "n").join(copies.withColumnRenamed("first", "head"), "class", "left")
    member = written(placed(member.select("doc", "body", "n", F.coalesce("head", "class").alias("class")), joined), "members")
    least = written(member.groupBy("component").agg(F.min("doc").alias("least")), "least")
    return member.join(least, "component").select("doc", "body", "n", F.col("component").alias("part"), F.col("least").alias("component"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """All documents with ``n_shingles``, ``component_id`` and ``kept`` (the document stands for its component)."""
    found = classes(docs, text, doc_id, size, percent).drop("part").distinct()
    found = written(found.select(F.col("doc").alias("_near_doc"), F.col("body").alias("_near_body"), F.col("n").alias("_near_n"), F.col("component").alias("_near_component")), "components")
    names = [c for c in docs.columns if c not in OUTPUT]
    own = docs.select(*names, F.xxhash64(plain(text)).alias("_near_own"))
    joined = own.join(found, (F.col(doc_id) == F.col("_near_doc")) & (F.col("_near_own") == F.col("_near_body")), "left")
    component = F.col("_near_component")
    return joined.select(*names, F.coalesce("_near_n", F.lit(0)).cast("long").alias("n_shingles"), component.alias("component_id"), (component.isNull() | (component == F.col(doc_id))).alias("kept"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component: of its smallest id, of that id's texts the one of least hash; rows without id all stay.

    A second row of an id goes only if its text is equal or linked. Rows are told by
    id and text hash, so that only rows that are repeated as a whole are moved.
    """
    found = written(classes(docs, text, doc_id, size, percent).select("doc", "body", "part"), "members")
    heads = found.groupBy("part").agg(F.min(F.struct("doc", "body")).alias("h"), F.count("*").alias("k")).filter("k > 1")
    heads = written(heads.select("part", "h"), "part-heads")
    gone = found.join(heads, "part").filter(F.struct("doc", "body") != F.col("h")).select("doc", "body").distinct()
    repeated = written(found.groupBy("doc", "body").agg(F.count("*").alias("k")).filter("k > 1").select("doc", "body"), "repeated")
    gone = written(gone.select("doc", "body"), "gone")
    keyed = docs.withColumn("_near_own", F.xxhash64(plain(text)))

    def those(rows: DataFrame, how: str) -> DataFrame:
        return keyed.join(counted(rows).select(F.col("doc").alias("_near_doc"), F.col("body").alias("_near_body")), (F.col(doc_id) == F.col("_near_doc")) & (F.col("_near_own") == F.col("_near_body")), how)

    if not repeated.head(1):
        return those(gone, "left_anti").select(*docs.columns)
    single = those(written(gone.union(repeated).distinct(), "gone"), "left_anti").select(*docs.columns)
    several = repeated.join(gone, ["doc", "body"], "left_anti")
    plain_columns = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    several = those(written(several, "several"), "left_semi").groupBy(F.col(doc_id).alias("_near_doc"), F.col("_near_own").alias("_near_body")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain_columns)).alias("_near_row"))
    return single.unionByName(several.select("_near_row.*"))
