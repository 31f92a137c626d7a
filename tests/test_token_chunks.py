"""Chunks by tokens beside a plain loop over the words; vitals by place."""

import random

from pyspark.sql import functions as F

from wardgraph.functions import notes
from wardgraph.operators import embedding


tokens = lambda word: {"none": 0, "huge": 70}.get(word, 1 + len(word) % 3)


def slow(words, size, overlap):
    step, total, at, out = size - overlap, sum(map(tokens, words)), 0, {}
    last = max(0, -(-(total - size) // step))
    for w in words:
        begin, at = at, at + tokens(w)
        fits = [k for k in range(last + 1) if k * step <= begin and at <= k * step + size]
        for k in fits or [min(last, begin // step)]:
            out.setdefault(k, []).append(w)
    return {k: " ".join(v) for k, v in out.items()}


def test_chunks_are_those_of_a_loop(spark):
    rng = random.Random(2)
    texts = {k: [rng.choice(["a", "bb", "ccc", "none", "dddd"] + ["huge"] * (k % 3 == 0)) for _ in range(n)] for k, n in enumerate([0, 1, 7, 40, 600, 1500, 513])}
    texts[20] = ["none"] * 4
    df = spark.createDataFrame([(k, w) for k, w in texts.items()], "k int, words array<string>")
    pieces = df.withColumn("ends", embedding.token_ends(tokens)(F.col("words"))).withColumn("total", F.try_element_at("ends", F.lit(-1))).withColumn("start", F.lit(0).cast("bigint"))
    got = {}
    for r in embedding.token_chunks(pieces, "k", 50, 10).collect():
        got.setdefault(r["k"], {})[r["chunk_no"]] = r["chunk"]
    assert got == {k: slow(w, 50, 10) for k, w in texts.items() if w}


def test_embedding_by_tokens(spark):
    df = spark.createDataFrame([(1, "word " * 1000), (2, "one"), (3, "  "), (4, None)], "k int, text string")
    got = {r["k"]: r["chunks"] for r in embedding.embed(df, "k", "text", count=lambda w: 2).collect()}
    words = embedding.CHUNK_WORDS - embedding.OVERLAP_WORDS
    assert got == {1: -(-(2000 - embedding.CHUNK_WORDS) // words) + 1, 2: 1}


def test_the_leftmost_vital_wins(spark):
    text = spark.createDataFrame([("Tm 98.6 BP 120/80 later T 97",), ("Heart Rate 80 then HR 90",), ("T 97 Tm 99",)], "t string")
    found = [r[0] for r in text.select(notes.vitals(F.col("t")).alias("v")).select("v.Temperature").collect()]
    assert [float(x) if x is not None else None for x in found] == [98.6, None, 97.0]
    assert [r[0] for r in text.select(notes.vitals(F.col("t"))["Heart Rate"]).collect()][1] in (80, 80.0, "80")
