"""Walking the event graph.

Nodes have ``label`` and ``key``; edges have ``src_label``, ``src_key``,
``rel``, ``dst_label``, ``dst_key``. A node is addressed by ``label|key``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardgraph.session import written

EDGE_KEY = ["src_label", "src_key", "rel", "dst_label", "dst_key"]

# Labels of helper nodes that walks leave out.
HELPER_LABELS = ["DiagnosisItem", "MedicationItem", "LabResultItem", "MicrobiologyResultItem"]


def address(label, key):
    return F.concat_ws("|", label, key)


def ends(edges: DataFrame) -> DataFrame:
    """Edges as pairs of addresses."""
    return edges.select(
        address(F.col("src_label"), F.col("src_key")).alias("src"),
        address(F.col("dst_label"), F.col("dst_key")).alias("dst"),
    )


def edges_between(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges, each once, whose two ends exist."""
    return (
        edges.join(sources.select(F.col("label").alias("src_label"), F.col("key").alias("src_key")), ["src_label", "src_key"], "left_semi")
        .join(targets.select(F.col("label").alias("dst_label"), F.col("key").alias("dst_key")), ["dst_label", "dst_key"], "left_semi")
        .dropDuplicates(EDGE_KEY)
        .select(*edges.columns)
    )


def _shortcuts(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, head) for nodes with one parent: the end of their chain of single parents.

    Pointers are doubled, so a chain of n nodes takes log2(n) rounds. The head
    has several parents, none, or is a root. Nodes of a closed ring of single
    parents have no head and cannot be reached from outside; they are left out.
    Only nodes that lead on take part in the rounds; the others, which are most
    of a patient's graph, look up the head of their parent once, at the end.
    """
    into = links.select(F.col("dst").alias("node"), F.col("src").alias("head"), F.lit(False).alias("leads"))
    out_of = links.select(F.col("src").alias("node"), F.lit(None).cast("string").alias("head"), F.lit(True).alias("leads"))
    single = (
        into.unionByName(out_of)
        .groupBy("node")
        .agg(F.count("head").alias("n"), F.min("head").alias("head"), F.max("leads").alias("leads"))
        .where(F.col("n") == 1)
        .join(roots.select(F.col("root").alias("node")), "node", "left_anti")
        .select("node", "head", "leads")
    )
    every = written(single, "chains")
    chains = every.where("leads").select("node", "head")
    total = chains.count()
    rounds = math.ceil(math.log2(total + 1)) + 2 if total else 0
    settled = []
    moving = chains
    for _ in range(rounds):
        onward = chains.select(F.col("node").alias("head"), F.col("head").alias("next"))
        stepped = written(
            moving.join(onward, "head", "left").select("node", "head", "next"), "chains"
        )
        settled.append(stepped.where(F.col("next").isNull()).select("node", "head"))
        moving = stepped.where(F.col("next").isNotNull()).select("node", F.col("next").alias("head"))
        if moving.isEmpty():
            break
        # Everyone's pointer doubles, so those still moving look up doubled ones.
        chains = moving.unionByName(_union(settled))
    leaves = every.where(~F.col("leads")).select("node", "head")
    if not settled:
        return leaves
    # Whoever moves to the end is in a ring or hangs off one, and so does its leaf.
    ends = _union(settled).unionByName(moving.select("node", F.lit(None).cast("string").alias("head")))
    ends = ends.select(F.col("node").alias("head"), F.col("head").alias("end"), F.lit(True).alias("known"))
    led = leaves.join(ends, "head", "left").select("node", F.when(F.col("known"), F.col("end")).otherwise(F.col("head")).alias("head"))
    return _union(settled).unionByName(led.where(F.col("head").isNotNull()))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def reachable(edges: DataFrame, roots: DataFrame, directed: bool = True) -> DataFrame:
    """Pairs (root, node) of everything a root leads to, at any depth, with itself.

    Long chains, such as a patient's flow through the hospital, are first cut
    short (``_shortcuts``); the walk then only visits roots and nodes with
    several parents. Each step is written to the shared folder.
    """
    pairs = ends(edges)
    if not directed:
        pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = written(pairs.where(F.col("src") != F.col("dst")).distinct(), "links")
    start = roots.select("root").distinct()
    short = written(_shortcuts(links, start), "heads")
    several = links.join(short.select(F.col("node").alias("dst")), "dst", "left_anti")
    hops = written(
        several.join(short.select(F.col("node").alias("src"), "head"), "src", "left")
        .select(F.coalesce("head", "src").alias("src"), "dst")
        .distinct(),
        "hops",
    )
    seen = written(start.select("root", F.col("root").alias("node")), "seen")
    frontier = seen
    while True:
        found = frontier.join(hops, frontier["node"] == hops["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = written(found.join(seen, ["root", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    # Each pair is there once: a node has one head, and no node with a head is in ``seen``.
    tails = seen.withColumnRenamed("node", "head").join(short, "head").select("root", "node")
    return seen.unionByName(tails)


def within(edges: DataFrame, roots: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """(root, node, hops) for nodes at most ``hops`` edges away, with the least number."""
    # Written one way; the other is the same rows read with their ends exchanged.
    links = written(ends(edges).distinct(), "links")
    if not directed:
        links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).cast("bigint").alias("hops")).distinct()
    frontier = seen
    for n in range(1, hops + 1):
        found = (
            frontier.join(links, frontier["node"] == links["src"])
            .select("root", F.col("dst").alias("node"))
            .distinct()
            .join(seen.select("root", "node"), ["root", "node"], "left_anti")
        )
        frontier = written(found.withColumn("hops", F.lit(n).cast("bigint")), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def path_edges(edges: DataFrame, roots: DataFrame, length: int = 3) -> DataFrame:
    """Edges on outgoing paths of at most ``length`` steps from a root, each once per root."""
    keyed = edges.withColumns(
        {
            "src": address(F.col("src_label"), F.col("src_key")),
            "dst": address(F.col("dst_label"), F.col("dst_key")),
        }
    )
    front = roots.select("root", F.col("root").alias("src")).distinct()
    steps = []
    for _ in range(length):
        step = keyed.join(front, "src").select("root", "src", "dst", *EDGE_KEY)
        steps.append(step)
        front = step.select("root", F.col("dst").alias("src")).distinct()
    return _union(steps).select("root", *EDGE_KEY).distinct()


def children(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Children without a time of their own, listed per parent and label."""
    untimed = nodes.where(F.col("ts").isNull()).select(
        F.col("label").alias("dst_label"), F.col("key").alias("dst_key"), "props"
    )
    return (
        edges.join(untimed, ["dst_label", "dst_key"])
        .groupBy("src_label", "src_key", "dst_label")
        .agg(
            F.array_sort(F.collect_list(F.struct("dst_key", "rel"))).alias("children"),
            F.count(F.lit(1)).alias("child_count"),
        )
    )


def described(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of their ends and the properties of their target."""
    a = nodes.select(F.col("label").alias("src_label"), F.col("key").alias("src_key"), F.col("name").alias("src_name"))
    b = nodes.select(
        F.col("label").alias("dst_label"), F.col("key").alias("dst_key"), F.col("name").alias("dst_name"), F.col("props").alias("dst_props")
    )
    return edges.join(a, ["src_label", "src_key"]).join(b, ["dst_label", "dst_key"])
