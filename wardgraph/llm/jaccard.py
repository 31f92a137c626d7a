"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Sets of shingles fall into size bands, narrow enough that a set is linked only within
its band and the bands beside it. Linked sets of which the smaller is in band b differ
in at most H(b) members. Space b cuts the range of all hashes into H(b) + 1 segments:
two sets with at most H(b) differences have equal members in one segment at least, so
a set is indexed by the digest of its members of each segment, in the space of its own
band and in that of the band below.

Members of a bucket are first joined by stars (``linking``), which is linear. The
classes of buckets that then still hold several components go on with less to find:
a member of a set that no other of these sets has is a sure difference, so that a set with
u of them needs coverage H + 1 - u only, over the segments of its other members. A
segment looked up as it is covers one difference, looked up with its one-deletion
neighbourhood (equal, one member more, or one less) it covers two. Each set covers what it
needs at the least cost, by the counts of the index's keys: a segment that
thousands share is passed over where rarer ones suffice. Candidates are verified on
full sets.

Sets that are equal are one class throughout. All links count, none is capped.

Defined cases: null and empty texts have an empty set and link with nothing; a text of
fewer words than the shingle has its whole sequence as its set; rows without id stand
alone (component null); rows of equal id are told apart by their texts, each with the
component of its own text; an empty table gives an empty table. Input columns
with the names of added columns are replaced.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardgraph.llm.common import ascii_lower, counted, plain, written
from wardgraph.llm.hashing import M1, M2, WordHashes, mixed
from wardgraph.llm.linking import ROUNDS, components, grow, placed
from wardgraph.llm.neardup import shingles

SHINGLE, PERCENT = 3, 90
# Longs of a set's bitmap: where two bitmaps differ, the sets do.
BITMAP = 16
OUTPUT = ["n_shingles", "component_id"]


class Bands:
    """Size bands: ``tops`` has the largest size of each; a set of band b is linked with none over band b + 1."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, []
        # Smaller sets that are linked are equal.
        self.least = -(-percent // (100 - percent)) if percent < 100 else None

    def of(self, size: int) -> int | None:
        """The band of a size; None where linked sets are equal ones."""
        if self.least is None or size < self.least:
            return None
        while not self.tops or self.tops[-1] < size:
            self.tops.append(self.least if not self.tops else max(self.tops[-1] + 1, 100 * self.tops[-1] // self.percent))
        return bisect_left(self.tops, size)

    def differences(self, band: int) -> int:
        """In how many members linked sets can differ whose smaller one is in the band."""
        return (100 - self.percent) * self.tops[band] // self.percent

    def spaces(self, size: int) -> list[int]:
        own = self.of(size)
        return [] if own is None else [own, own - 1] if own else [own]


def _cuts(members: np.ndarray, segments: int) -> np.ndarray:
    """Places at which the sorted members are cut: equal parts of the range of hashes."""
    borders = [(k << 64) // segments for k in range(1, segments)]
    return np.r_[0, np.searchsorted(members, np.array(borders, np.uint64)), len(members)]


def segment_keys(members: np.ndarray, space: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted members: the salt and the sum of each segment, the segment of each member, and each member's term."""
    cuts = _cuts(members, segments)
    terms = mixed(members * M2 + np.uint64(7))
    sums = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
    salts = mixed(np.arange(segments, dtype=np.uint64) * M2 + np.uint64((space + 1) * int(M1) % 2**64))
    return salts, sums[cuts[1:]] - sums[cuts[:-1]], np.repeat(np.arange(segments), np.diff(cuts)), terms


def _set_of(text: pa.Scalar, known: WordHashes, size: int) -> np.ndarray:
    return shingles(text.as_py().encode().split(), known, size)


def _bits(members: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * BITMAP, bool)
    bits[members % np.uint64(64 * BITMAP)] = True
    return np.packbits(bits).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


LONGS = T.ArrayType(T.LongType(), False)
INDEXED = [T.StructField("n", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("bits", LONGS), T.StructField("own", LONGS), T.StructField("below", LONGS)]


def _indexed(size: int, percent: int):
    """Size, digest, bitmap and the keys of all segments of each set, in the space of its band and of the band below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bands, none = WordHashes(), Bands(percent), np.zeros(0, np.uint64)
        for batch in batches:
            texts = batch.column("words")
            for start in range(0, batch.num_rows, 1000):
                rows = range(start, min(start + 1000, batch.num_rows))
                counts, same, bits, keys = [], [], [], ([], [])
                for i in rows:
                    own = _set_of(texts[i], known, size)
                    counts.append(len(own))
                    same.append(blake2b(own.tobytes(), digest_size=16).digest())
                    bits.append(_bits(own))
                    spaces = bands.spaces(len(own))
                    for k in range(2):
                        if k < len(spaces):
                            salts, sums, _, _ = segment_keys(own, spaces[k], bands.differences(spaces[k]) + 1)
                            keys[k].append(mixed(sums + salts))
                        else:
                            keys[k].append(none)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(start, len(rows)) for c in ("doc", "body")] + [pa.array(counts, pa.int64()), pa.array(same, pa.binary()), _lists(bits), _lists(keys[0]), _lists(keys[1])],
                    names=["doc", "body", "n", "same", "bits", "own", "below"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([part.column("class"), _lists([_set_of(x, known, size) for x in part.column("words")])], names=["class", "set"])

    return run


def _neighbourhoods(percent: int):
    """The rows of the second index: of each space a key for each segment, and one for each member left out of its segment."""

    def rows_of(number: int, n: int, members: np.ndarray, bands: Bands) -> Iterator[tuple]:
        for space in bands.spaces(n):
            most = bands.differences(space)
            need = most + 1 - (n - len(members))
            if need <= 0:
                continue
            salts, sums, at, terms = segment_keys(members, space, most + 1)
            keys = np.r_[mixed(sums + salts), mixed(sums[at] - terms + salts[at])]
            count = len(keys)
            ids = np.full(count, number, np.int64), np.full(count, space, np.int32), np.full(count, need, np.int32)
            yield *ids, np.r_[np.arange(most + 1), at].astype(np.int32), np.arange(count) > most, keys.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, names = Bands(percent), [f.split()[0] for f in NEIGHBOURS.split(", ")]
        for batch in batches:
            made: list[tuple] = []
            ids, sizes, kept = (batch.column(c) for c in ("class", "n", "kept"))
            for i in range(batch.num_rows):
                made += rows_of(ids[i].as_py(), sizes[i].as_py(), np.sort(kept[i].values.to_numpy().view(np.uint64)), bands)
                if len(made) >= 500 or sum(len(x[0]) for x in made[-20:]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made)], names=names)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made)], names=names)

    return run


NEIGHBOURS = "class long, space int, need int, segment int, less boolean, key long"


def allocate(segments: int, need: int, exact: dict[int, int], wider: dict[int, int]) -> dict[int, int]:
    """How many differences (1 or 2) each segment covers, at least ``need`` together, cheapest first.

    ``exact`` and ``wider`` have the candidates that a segment gives as it is, and
    that its neighbourhood adds; a segment that is not there gives none.
    """
    costs = [(exact.get(i, 0), 1, i) for i in range(segments)]
    heapq.heapify(costs)
    chosen: dict[int, int] = {}
    for _ in range(need):
        _, level, i = heapq.heappop(costs)
        chosen[i] = level
        if level == 1:
            heapq.heappush(costs, (wider.get(i, 0), 2, i))
    return chosen


def _allocated(percent: int):
    """(class, key, less, wide): what each set looks up; ``wide`` ones also among keys with a member less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                bands.of(r["n"])
                exact, wider = {}, {}
                for x in r["rows"]:
                    i = x["segment"]
                    if x["less"]:
                        wider[i] = wider.get(i, 0) + x["wholes"]
                    else:
                        exact[i] = exact.get(i, 0) + x["wholes"] - 1
                        wider[i] = wider.get(i, 0) + x["lesses"]
                chosen = allocate(bands.differences(r["space"]) + 1, r["need"], exact, wider)
                for x in r["rows"]:
                    level = chosen.get(x["segment"], 0)
                    if level > int(x["less"]):
                        out.append((r["class"], x["key"], x["less"], level == 2))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], names=["class", "key", "less", "wide"])

    return run


def _can_link(percent: int, n: str, m: str, x: str, y: str):
    """Whether sizes and bitmaps leave room for a link."""
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (F.col(n) + F.col(m)))


class _Links:
    """What is known of the classes, and the check of pairs on full sets."""

    def __init__(self, heads: DataFrame, keyed: DataFrame, size: int, percent: int):
        self.heads, self.keyed, self.size, self.percent = heads, keyed, size, percent

    def sets(self, classes: DataFrame) -> DataFrame:
        """(class, set) of classes, from their texts."""
        ids = written(self.heads.join(counted(classes), "class", "left_semi").select("doc", "body", "class"), "class-ids")
        words = self.keyed.join(counted(ids), ["doc", "body"]).select("class", "words")
        return written(words.mapInArrow(_sets(self.size), T.StructType([T.StructField("class", T.LongType()), T.StructField("set", LONGS)])).dropDuplicates(["class"]), "sets")

    def of(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of pairs (a, b)."""
        sides = [self.heads.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"]
        near = pairs.join(sides[0], "a").join(sides[1], "b").filter(_can_link(self.percent, "n_a", "n_b", "bits_a", "bits_b"))
        near = written(near.select("a", "b", "n_a", "n_b"), "near")
        ends = written(near.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "ends")
        sets = self.sets(ends)
        # A head has many partners: its set comes last, where Spark need not carry it for each.
        often = near.groupBy("a").agg(F.count("*").alias("k_a")), near.groupBy("b").agg(F.count("*").alias("k_b"))
        turned = near.join(often[0], "a").join(often[1], "b")
        x, y = F.when(F.col("k_a") >= F.col("k_b"), F.col("a")).otherwise(F.col("b")), F.when(F.col("k_a") >= F.col("k_b"), F.col("b")).otherwise(F.col("a"))
        turned = written(turned.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), x.alias("x"), y.alias("y")), "turned")
        both = turned.join(sets.select(F.col("class").alias("y"), F.col("set").alias("set_y")), "y").join(sets.select(F.col("class").alias("x"), F.col("set").alias("set_x")), "x")
        common = F.size(F.array_intersect("set_x", "set_y"))
        return both.filter(100 * common >= self.percent * (F.col("n") - common)).select("a", "b")


def _undecided_pairs(crowd: DataFrame, links: _Links) -> DataFrame:
    """Pairs (a, b) of a crowd (class, component) that can be linked, in different components: the second index."""
    percent = links.percent
    sizes = links.heads.select("class", "n", "bits").join(crowd, "class")
    sets = links.sets(crowd.select("class"))
    each = sets.select("class", F.explode("set").alias("member"))
    common = written(each.groupBy("member").agg(F.count("*").alias("k")).filter("k > 1").select("member"), "common-members")
    kept = each.join(common, "member").groupBy("class").agg(F.collect_list("member").alias("kept"))
    kept = written(kept.join(sizes, "class").withColumn("sure", F.col("n") - F.size("kept")), "kept")
    rows = written(kept.select("class", "n", "kept").mapInArrow(_neighbourhoods(percent), NEIGHBOURS), "neighbourhoods")
    counts = rows.groupBy("key").agg(F.count_if(~F.col("less")).alias("wholes"), F.count_if("less").alias("lesses")).filter("wholes > 0 AND wholes + lesses > 1")
    live = written(rows.join(written(counts, "key-counts"), "key"), "live-keys")
    ranked = live.groupBy("class", "space", "need").agg(F.collect_list(F.struct("segment", "less", "key", "wholes", "lesses")).alias("rows")).join(kept.select("class", "n"), "class")
    probes = ranked.mapInArrow(_allocated(percent), "class long, key long, less boolean, wide boolean")

    known = kept.select("class", "n", "sure", "component", "bits")
    probes = written(probes.join(known, "class"), "probes")
    index = live.select("key", "less", "class").join(known, "class")
    p, i = probes.alias("p"), index.alias("i")
    n, sure = F.col("p.n") + F.col("i.n"), F.col("p.sure") + F.col("i.sure")
    met = (F.col("p.key") == F.col("i.key")) & (F.col("p.component") != F.col("i.component")) & (~F.col("i.less") | (F.col("p.wide") & ~F.col("p.less")))
    met = met & ((100 + percent) * sure <= (100 - percent) * n) & _can_link(percent, "p.n", "i.n", "p.bits", "i.bits")
    return p.join(i, met).select(F.least("p.class", "i.class").alias("a"), F.greatest("p.class", "i.class").alias("b")).distinct()


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(doc, body, n, component): the size of each text's set and the smallest id reachable by links; ``body`` is the text's hash."""
    keyed = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(plain(text)).alias("body"), ascii_lower(plain(text)).alias("words")).filter("doc IS NOT NULL")
    row = T.StructType([keyed.schema["doc"], T.StructField("body", T.LongType()), *INDEXED])
    units = written(keyed.mapInArrow(_indexed(size, percent), row).withColumn("class", F.monotonically_increasing_id()), "units")
    filled = units.filter("n > 0")
    groups = filled.groupBy("n", "same").agg(F.min("class").alias("first"), F.count("*").alias("k")).filter("k > 1").select("n", "same", "first")
    # Written, so that Spark can split the join where one set has many copies.
    copies = written(filled.select("n", "same", "class").join(written(groups, "groups"), ["n", "same"]).filter("class <> first").select("class", "first"), "copies")
    heads = filled.join(counted(copies.select("class")), "class", "left_anti")

    keys = heads.select("class", F.posexplode(F.concat("own", "below")).alias("place", "key"), F.size("own").alias("_own"))
    met = keys.groupBy("key").agg(F.count("*").alias("k"), F.count_if(F.col("place") < F.col("_own")).alias("smaller")).filter("k > 1 AND smaller > 0").select("key")
    live = written(keys.join(written(met, "met"), "key").select("key", "class"), "live")
    rank = live.groupBy("class").agg(F.count("*").alias("rank"))
    buckets = written(live.join(rank, "class"), "buckets")

    links = _Links(heads, keyed, size, percent)
    joined, crowd = grow(buckets, links.of, rounds)
    if crowd.head(1):
        found = links.of(written(_undecided_pairs(crowd, links), "undecided-pairs"))
        joined = components(found.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    # Classes are numbers of rows; a component is told by its smallest id.
    member = units.select("class", "doc", "body", "n").join(copies.withColumnRenamed("first", "head"), "class", "left")
    member = written(placed(member.select("doc", "body", "n", F.coalesce("head", "class").alias("class")), joined), "members")
    least = written(member.groupBy("component").agg(F.min("doc").alias("least")), "least")
    return member.join(least, "component").select("doc", "body", "n", F.col("least").alias("component"))


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """All documents with ``n_shingles`` and ``component_id``."""
    found = classes(docs, text, doc_id, size, percent, rounds).distinct()
    found = written(found.select(F.col("doc").alias("_jac_doc"), F.col("body").alias("_jac_body"), F.col("n").alias("_jac_n"), F.col("component").alias("_jac_component")), "components")
    names = [c for c in docs.columns if c not in OUTPUT]
    own = docs.select(*names, F.xxhash64(plain(text)).alias("_jac_own"))
    joined = own.join(found, (F.col(doc_id) == F.col("_jac_doc")) & (F.col("_jac_own") == F.col("_jac_body")), "left")
    return joined.select(*names, F.coalesce("_jac_n", F.lit(0)).cast("long").alias("n_shingles"), F.col("_jac_component").alias("component_id"))
