"""Components of a similarity graph whose candidate pairs stand in buckets.

Members of one bucket may be linked; a bucket may hold a third of all. Instead of its
pairs, ``grow`` tests stars: in each round a member against one or two heads of its
buckets, of other components, which is linear in the members. Links that are found
join components, so that later rounds test components against each other through
ever other heads. What is left is returned: the members of buckets that still hold
several components. The caller has to decide these exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.llm.common import written

ROUNDS = 3


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): the smallest node reachable.

    Alternating star contractions: each node hands its larger neighbours, then its
    smaller ones, to the least of them, until only stars around their least node
    remain; the number of rounds grows with the logarithm of a component's diameter.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while _tangled(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _tangled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are more than stars: a node with two lesser neighbours, or with lesser and greater ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e"))
    counts = ends.groupBy("e.node").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up"))
    return bool(counts.filter("down > 1 OR (down > 0 AND up > 0)").head(1))


def placed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``rows`` with the ``component`` of their column ``class``; a class without links is its own."""
    at = joined.select(F.col("node").alias("class"), F.col("component"))
    return rows.drop("component").join(at, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _open(located: DataFrame) -> DataFrame:
    """The rows of the buckets with several components, with the bucket's number of members ``k``."""
    parts = located.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("k")).filter("least <> most").select("key", "k")
    return located.drop("k").join(parts, "key")


def _stars(located: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b): each member beside one head of its buckets, of another component.

    The first round's heads are the most central members, and a member is tested
    against the most central of its heads. Later rounds have two heads a bucket, in
    the component with most members and in another, which change by the round, and
    test a member against two of its heads.
    """
    if number == 0:
        whole = F.struct("rank", F.col("class").alias("head"), F.col("component").alias("of"))
        heads = located.groupBy("key").agg(F.max(whole).alias("h")).select("key", "h.*")
    else:
        turn = F.xxhash64("class", F.lit(number))
        by_part = located.groupBy("key", "component").agg(F.count("*").alias("k"), F.max_by("class", F.struct(turn, "class")).alias("head"))
        one = F.struct(F.xxhash64("head", F.lit(-number)).alias("rank"), "head", F.col("component").alias("of"))
        ranked = by_part.groupBy("key").agg(F.max_by(one, F.struct("k", "component")).alias("x"), F.max_by(one, F.struct(F.xxhash64("component", F.lit(number)), "component")).alias("y"))
        heads = ranked.select("key", F.explode(F.array_distinct(F.array("x", "y"))).alias("h")).select("key", "h.*")
    heads = written(heads.withColumnRenamed("rank", "of_rank"), "bucket-heads")
    met = located.join(heads, "key").filter("component <> of").select("class", F.struct(F.col("of_rank"), "head").alias("h"))
    best = met.groupBy("class").agg(F.array_distinct(F.array(F.max("h"), F.min("h") if number else F.max("h"))).alias("h"))
    return best.select("class", F.explode("h.head").alias("head")).select(F.least("head", "class").alias("a"), F.greatest("head", "class").alias("b")).distinct()


def grow(buckets: DataFrame, linked: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS, halving: bool = False) -> tuple[DataFrame, DataFrame]:
    """Components (node, component) by stars, and (class, component) of the members still to be decided.

    ``buckets`` has (key, class, rank), keys with several members, ``rank`` larger for
    members that more buckets hold; ``linked`` keeps the linked ones of pairs (a, b).
    Buckets of two members, one pair each, are decided here. With ``halving`` a further
    round follows only one that closed at least half of the open rows; what a round
    that is left out would have joined is among the members returned.
    """
    joined = components(buckets.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0))

    def more(found: DataFrame) -> DataFrame:
        return components(found.union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    located = written(_open(buckets.withColumn("component", F.col("class"))), "open")
    left = located.count()
    tested = None
    for number in range(rounds):
        pairs = written(_stars(located, number), "stars")
        tested = pairs if tested is None else tested.union(pairs)
        found = written(linked(pairs), "star-links")
        if number and not found.head(1):
            break
        joined = more(found)
        located = written(_open(placed(located, joined)), "open")
        before, left = left, located.count()
        if not left or halving and 2 * left > before:
            break
    two = located.filter("k = 2").groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).select("a", "b").distinct()
    two = written(two if tested is None else two.join(tested, ["a", "b"], "left_anti"), "bucket-pairs")
    if two.head(1):
        joined = more(linked(two))
        located = _open(placed(located, joined))
    return joined, written(located.filter("k > 2").select("class", "component").distinct(), "undecided")


def grow_halving(buckets: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``grow`` with rounds only while they pay."""
    return grow(buckets, linked, halving=True)
