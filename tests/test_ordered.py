"""Sliced ordered operators against plain loops over random flows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wardgraph.operators import flow, ordered

BASE = datetime(2150, 1, 1)


def random_rows(seed, keys=30, most=40):
    rnd = random.Random(seed)
    rows, ident = [], 0
    for key in range(keys):
        now = BASE
        for _ in range(rnd.randint(1, most)):
            ident += 1
            now += timedelta(hours=rnd.choice([0, 1, 5, 30, 200]))
            rows.append((key, now, ident, rnd.choice(["a", "b", None])))
    rnd.shuffle(rows)
    return rows


def test_along_equals_a_loop(spark):
    rows = random_rows(1)
    df = spark.createDataFrame(rows, "key bigint, ts timestamp_ntz, id bigint, v string")
    got = ordered.along(
        df, ["key"], ["ts", "id"],
        ordered.number("n"), ordered.previous("p", F.col("v")), ordered.last_known("l", F.col("v")),
        ordered.next_known("f", F.col("v")), ordered.total_before("t", F.col("id")),
    ).collect()
    by_id = {r.id: r for r in got}
    assert len(by_id) == len(rows)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    for group in groups.values():
        for i, (_, _, ident, _) in enumerate(group):
            r = by_id[ident]
            before, after = [g[3] for g in group[:i]], [g[3] for g in group[i + 1 :]]
            assert r.n == i + 1
            assert r.p == (before[-1] if before else None)
            assert r.l == next((x for x in reversed(before) if x), None)
            assert r.f == next((x for x in after if x), None)
            assert r.t == sum(g[2] for g in group[:i])


def test_merging_stays_equals_a_loop(spark):
    rnd = random.Random(5)
    rows, ident = [], 0
    for hadm in range(40):
        now = BASE
        for _ in range(rnd.randint(1, 25)):
            ident += 1
            end = now + timedelta(hours=rnd.choice([2, 9, 40]))
            kind = rnd.choice(["admit", "transfer", "transfer", "transfer", "ed"])
            rows.append((hadm % 7, hadm, ident, kind, rnd.choice(["A", "A", "B"]), now, end))
            now = end if rnd.random() < 0.8 else end + timedelta(hours=1)
        rows.append((hadm % 7, hadm, ident + 1000, "discharge", None, now, None))
    df = spark.createDataFrame(
        rows, "subject_id bigint, hadm_id bigint, transfer_id bigint, eventtype string, careunit string, intime timestamp_ntz, outtime timestamp_ntz"
    )
    want_stays, want_edges = set(), set()
    for hadm in range(40):
        last, kept = None, []
        for r in sorted((r for r in rows if r[1] == hadm), key=lambda r: (r[5], r[2])):
            unit = r[3] in ("admit", "transfer")
            if last and unit and last["unit"] and last["care"] == r[4] and last["out"] == r[5]:
                last["out"] = r[6]
            else:
                last = {"id": str(r[2]), "unit": unit, "care": r[4], "out": r[6], "kind": r[3], "in": r[5]}
                kept.append(last)
        want_stays |= {(k["id"], k["in"], k["out"]) for k in kept}
        want_edges |= {(a["id"], b["id"]) for a, b in zip(kept, kept[1:]) if b["kind"] != "ed"}
    stays = flow.continuous_stays(df)
    assert {(r.event_id, r.intime, r.outtime) for r in stays.collect()} == want_stays
    edges = flow.flow_edges(flow.with_previous_stay(stays)).collect()
    assert {(e.src_key, e.dst_key) for e in edges} == want_edges
    # Nothing is left that could be merged once more.
    again = stays.withColumn("transfer_id", F.col("event_id").cast("bigint")).drop("service_given", "event_id", "label", "name", "period", "merged_rows")
    assert flow.continuous_stays(again).count() == stays.count()


def test_next_visit_equals_a_loop(spark):
    rnd = random.Random(9)
    rows = [(s, f"{k}{i}", BASE + timedelta(hours=rnd.randint(0, 400)), k) for s in range(20) for i, k in enumerate(rnd.choices("dv", k=25))]
    df = spark.createDataFrame(rows, "subject_id bigint, event_id string, intime timestamp_ntz, k string")
    got = flow.next_ed_visit(df.where("k = 'd'"), df.where("k = 'v'")).collect()
    want = set()
    for s, ident, now, k in rows:
        later = sorted((r[2], r[1]) for r in rows if r[0] == s and r[3] == "v" and r[2] > now)
        if k == "d" and later:
            want.add((s, ident, later[0][1]))
    assert {(r.subject_id, r.discharge_id, r.ed_event_id) for r in got} == want


def test_rows_are_shuffled_once_for_runs(spark):
    """The summary of the slices is taken from the rows as they lie for the windows."""
    rows = [(1, 10, BASE + timedelta(days=40 * i), None, i, "admit", "a") for i in range(6)]
    schema = "subject_id bigint, hadm_id bigint, intime timestamp_ntz, outtime timestamp_ntz, transfer_id bigint, eventtype string, careunit string"
    stays = flow.continuous_stays(spark.createDataFrame(rows, schema))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, value in settings.items():
            spark.conf.set(k, value)
        text = stays._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    by_slice = [line for line in text.splitlines() if " Exchange hashpartitioning(subject_id" in line and "_slice" in line and "Reused" not in line]
    assert "ReusedExchange" in text and len(by_slice) == 2  # the rows, and the summary
    assert stays.count() == 6


def test_previous_fields_are_not_shuffled_twice(spark):
    df = spark.createDataFrame(random_rows(3), "key bigint, ts timestamp_ntz, id bigint, v string")
    seen = ordered.along(df, ["key"], ["ts", "id"], ordered.previous("p", fields=["id", "v"]))
    plain = ordered.along(df, ["key"], ["ts", "id"], ordered.previous("p", F.struct("id", "v")))
    assert sorted(map(str, seen.collect())) == sorted(map(str, plain.collect()))


def test_a_slice_holds_more_than_a_day(spark):
    days = spark.range(60).selectExpr("1L as key", "id", "cast(timestampadd(DAY, cast(id as int), timestamp'2150-01-01') as timestamp_ntz) as ts")
    assert ordered.with_slice(days, "ts").select(ordered.SLICE).distinct().count() < 12
