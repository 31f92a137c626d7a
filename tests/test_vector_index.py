"""The stored vector index: growing, unknown patients, twins, what a search reads."""

import random

from pyspark.sql import functions as F

from wardgraph.suite.registry import QUERIES
from wardgraph.operators import similarity, vector_index

DDL = "subject_id bigint, vector array<float>"


def rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)]


def test_grows_and_finds_exactly_with_all_cells(spark, tmp_path):
    made = rows(120)
    made += [(500, made[3][1]), (501, [0.0] * 8), (502, None), (503, [1.0] * 5)]
    df = spark.createDataFrame(made, DDL)
    index = vector_index.build(df.where("subject_id < 60 OR subject_id >= 500"), str(tmp_path / "ix"), cells=6)
    more = df.where("subject_id < 120 AND subject_id >= 50")
    for _ in range(2):  # a repeated addition stores nothing twice
        vector_index.add(index, more)
    assert index.vectors.count() == 121
    got = vector_index.nearest_patients(index, 3, 10, probes=6).collect()
    want = similarity.patients(df.where(F.size("vector") == 8), 3, 10).collect()
    assert [r.subject_id for r in got] == [r.subject_id for r in want] and 500 not in [r.subject_id for r in got]
    assert all(abs(a.score - b.score) < 1e-9 for a, b in zip(got, want))


def test_unknown_patient_and_pruning(spark, tmp_path):
    index = vector_index.build(spark.createDataFrame(rows(200), DDL), str(tmp_path / "ix"), cells=8)
    assert vector_index.nearest_patients(index, 9999).collect() == []
    found = vector_index.nearest_patients(index, 5, 5, probes=2)
    assert found.count() == 5
    assert "dynamicpruning" in found._jdf.queryExecution().toString()


def test_diagnosis_texts_are_made_once_for_vectors_and_search(spark, tmp_path, monkeypatch):
    from wardgraph.suite import vectors

    made = []

    def listed(v):
        made.append(v)
        rows = [(1, ["red widget", "small ring"]), (2, ["blue bolt"]), (3, ["green gear"]), (None, ["blue bolt"])]
        return spark.createDataFrame(rows, "subject_id bigint, all_diagnoses array<string>")

    monkeypatch.setattr(vectors, "all_diagnoses", listed)
    best = QUERIES["v5_patients_by_diagnosis"](spark, str(tmp_path)).collect()
    assert [(r.subject_id, r.all_diagnoses) for r in best] == [(1, "red widget | small ring"), (2, "blue bolt"), (3, "green gear")]
    assert len(made) == 1


def test_few_queries_find_what_many_do_and_send_only_their_best(spark, tmp_path, monkeypatch):
    made = rows(300)
    made += [(1000 + i, made[i % 40][1]) for i in range(80)]  # copies tie, so the least key must win
    made += [(2000, [0.0] * 8), (2001, None), (2002, [1.0] * 5), (2003, [None] + [1.0] * 7), (None, made[9][1])]
    df = spark.createDataFrame(made, DDL).repartition(3)
    index = vector_index.build(df, str(tmp_path / "ix"), cells=6)
    asked = vector_index.asked_for(index, F.col("subject_id") % 25 == 0)

    def told(found):
        return sorted((r.query, r.subject_id is None, r.subject_id or 0, r.score) for r in found.collect())

    few = {p: vector_index.search(index, asked, 7, p) for p in (2, 6)}
    plans = [d._jdf.queryExecution().toString() for d in few.values()]
    assert all("MapInArrow" in p and "dynamicpruning" in p for p in plans)
    few = {p: told(d) for p, d in few.items()}
    monkeypatch.setattr(vector_index, "BLOCK", 2)
    assert few == {p: told(vector_index.search(index, asked, 7, p)) for p in (2, 6)}

    others = df.join(asked, F.col("subject_id") != F.col("query"))
    scored = others.select("query", "subject_id", similarity.cosine(F.col("vector"), F.col("unit")).alias("score"))
    want = {}
    for r in scored.where(F.round("score", 12) < 1.0).collect():
        want.setdefault(r.query, []).append((-r.score, r.subject_id))
    want = {(q, key, -s) for q, best in want.items() for s, key in sorted(best)[:7]}
    assert {(r.query, r.subject_id, r.score) for r in vector_index.exact(df, asked, 7).collect()} == want


def test_learning_reads_all_vectors_a_fixed_number_of_times(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows(200), DDL)
    vector_index.build(df.mapInArrow(counted, df.schema), str(tmp_path / "ix"), cells=4)
    assert seen.value <= 5 * 200


def test_norms_are_not_computed_for_every_place(spark):
    df = spark.createDataFrame(rows(3), DDL)
    text = vector_index._unit(df, "subject_id")._jdf.queryExecution().optimizedPlan().toString()
    # One for the filter, one for the division, which divides by a bound variable.
    assert text.count("SQRT(") == 2 and "/ SQRT(" not in text and "/ lambda" in text
