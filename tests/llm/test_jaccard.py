"""The n-gram Jaccard join beside all pairs, on near copies around the threshold and on hard rows."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardgraph.llm import jaccard

WORD = re.compile("[^\x20\x09-\x0d]+")


def sets_of(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))) if len(words) >= size else frozenset([tuple(words)])


def all_pairs(rows, size, percent):
    """(n_shingles, component) of each row by comparing all pairs."""
    sets = [sets_of(t, size) for _, t in rows]
    least = [i for i, _ in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return [(i, t, 0 if i is None else len(s), c) for (i, t), s, c in zip(rows, sets, least)], len(links)


def crowd(seed, n=150):
    """Families of texts of many lengths that differ in own words, words of the family, or missing ones."""
    rng, rows = random.Random(seed), []
    for family in range(8):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 11, 14, 25, 60, 120, 300]))]
        pool = [f"f{family}x{k}" for k in range(3)]
        for _ in range(n // 8):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25) + 1)):
                at = rng.randrange(len(own))
                kind = rng.random()
                if kind < 0.4:
                    own[at] = f"u{rng.randrange(10**9)}"
                elif kind < 0.7:
                    own[at] = rng.choice(pool)
                elif kind < 0.85 and len(own) > 2:
                    del own[at]
                else:
                    own.insert(at, rng.choice(pool))
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "size", "percent", "rounds"), [(1, 3, 90, 3), (2, 3, 90, 1), (3, 1, 90, 1), (4, 2, 75, 1)])
def test_like_all_pairs(spark, seed, size, percent, rounds):
    rows = crowd(seed)
    want, links = all_pairs(rows, size, percent)
    assert links > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.jaccard_components(docs, size=size, percent=percent, rounds=rounds).collect()
    assert sorted((r.doc_id, r.text, r.n_shingles, r.component_id) for r in got) == want


def test_no_links_but_by_the_second_index(spark, monkeypatch):
    """With stars that test nothing the second index finds all links by itself."""
    rows = crowd(9)
    want, _ = all_pairs(rows, 3, 90)

    def undecided_alone(buckets, linked, rounds):
        joined = jaccard.components(buckets.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0))
        return joined, buckets.select("class", F.col("class").alias("component")).distinct()

    monkeypatch.setattr(jaccard, "grow", undecided_alone)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_shingles, r.component_id) for r in got) == want


def test_hard_rows(spark):
    base = " ".join(f"w{k}" for k in range(80))
    near = base.replace("w79", "other")
    rows = [(5, base), (5, base), (7, base.upper()), (9, near), (3, None), (4, ""), (6, " \n\t"), (8, "one"), (10, "One"), (11, "one two"), (None, base), (None, None), (12, "é \U0001f600 b\x0cc"), (5, "another text of five"), (2, "another text of five")]
    rows.append((13, " ".join(f"v{k}" for k in range(30_000))))
    rows.append((14, " ".join(f"v{k}" for k in range(29_000))))
    want, _ = all_pairs(rows, 3, 90)
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], "doc_id long, text string, component_id string, doc int").repartition(2)
    made = jaccard.jaccard_components(docs)
    assert made.columns == ["doc_id", "text", "doc", "n_shingles", "component_id"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[3] is None)
    # Rows without id stand alone; rows of one id are told apart by their texts.
    assert sorted([(r.doc_id, r.text, r.n_shingles, r.component_id) for r in made.collect()], key=key) == sorted(want, key=key)
    assert jaccard.jaccard_components(docs.limit(0)).collect() == []


def test_bands_hold_all_linked_sizes():
    for percent in (60, 80, 90, 95):
        bands = jaccard.Bands(percent)
        for n in range(1, 400):
            for m in range(n, 100 * n // percent + 1):
                if n == m and bands.of(n) is None:
                    continue
                spaces = set(bands.spaces(n)) & set(bands.spaces(m))
                # The most that two linked sets of these sizes can differ in.
                common = -(-percent * (n + m) // (100 + percent))
                if common <= n and m + n - 2 * common > 0:
                    assert bands.of(n) in spaces and bands.differences(bands.of(n)) >= n + m - 2 * common


def test_allocation_covers_the_need_cheaply():
    assert jaccard.allocate(4, 3, {0: 9, 1: 1, 2: 2}, {1: 5, 3: 7}) == {3: 1, 1: 1, 2: 1}
    assert jaccard.allocate(2, 2, {0: 1000}, {1: 3}) == {1: 2}
    rng = np.random.default_rng(2)
    for _ in range(50):
        m = int(rng.integers(1, 9))
        need = int(rng.integers(1, m + 1))
        cost = {i: int(rng.integers(0, 50)) for i in range(m)}
        assert sum(jaccard.allocate(m, need, cost, {i: int(rng.integers(0, 50)) for i in range(m)}).values()) == need
