"""Semantics that the queries over the driver's tables can't show: repeated keys, rejected sessions, plans."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sparkloom import queries
from sparkloom.operators import metrics, splits
from sparkloom.streaming import sessions

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,most", [("parse_answers", 12), ("summary_rates", 14), ("multi_turn", 14), ("reward_breakdown", 70)])
def test_responses_are_parsed_once(spark, name, most):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_|RLIKE", plan)) <= most


def test_of_repeated_ids_the_last_row_is_paired(spark):
    rows = lambda *v: spark.createDataFrame([(k, i, ok) for i, (k, ok) in enumerate(v)], "example_id string, at long, target_selected boolean").repartition(3)
    a = rows(("x", True), ("y", False), ("x", False), ("y", True), ("x", False), ("y", True))
    b = rows(("y", False), ("x", True))
    got = metrics.paired(a, b, order="at").first()
    assert (got.matched_examples, got.baseline_only_correct, got.candidate_only_correct) == (2, 1, 1)
    assert metrics.paired(a.coalesce(1).orderBy("at"), b).first().matched_examples == 2


def test_bootstrap_needs_two_clusters(spark):
    rows = [("q", i % 2 == 0) for i in range(10)]
    one = spark.createDataFrame(rows, "base_question_id string, target_selected boolean")
    assert tuple(metrics.bootstrap(one).first()) == (None, None) and metrics.bootstrap_compatible(one) is None
    assert tuple(metrics.bootstrap(one.limit(0)).first()) == (None, None)


def slow_admit(rows, cap):
    out, ends = {}, []
    for name, start, end in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
        ends = [e for e in ends if e is None or e > start]
        out[name] = (len(ends), len(ends) < cap)
        if len(ends) < cap:
            ends.append(end)
    return out | {r[0]: (None, False) for r in rows if r[1] is None}


def test_rejected_sessions_are_not_open(spark):
    import random
    from datetime import datetime, timedelta

    at = lambda h, m: datetime(2024, 1, 1, h, m)
    few = [("a", at(10, 0), at(11, 0)), ("b", at(10, 10), at(12, 0)), ("c", at(11, 30), at(11, 40)), ("d", None, at(11, 0))]
    rng = random.Random(3)
    many = []
    for i in range(400):
        start = at(0, 0) + timedelta(minutes=rng.randrange(0, 4000, 5))
        many.append((f"s{i:03}", start, start + timedelta(minutes=rng.choice([0, 5, 20, 45, 300]))))
    many.append(("s999", at(5, 0) + timedelta(days=2, hours=15), None))
    for rows, cap in ((few, 1), (many, 1), (many, 3), (few[:0], 2)):
        df = spark.createDataFrame(rows, "name string, started timestamp, ended timestamp").repartition(3)
        got = {r.name: (r.open, r.admitted) for r in sessions.admit(df, "started", "ended", "name", cap).collect()}
        assert got == slow_admit(rows, cap)


@pytest.mark.parametrize("most", [None, 30])
def test_places_of_shards(spark, most):
    df = spark.range(100).withColumn("x", F.col("id") * 37 % 101).repartition(5)
    ordered = [r.id for r in df.orderBy("x").collect()][:most]
    for shard in range(3):
        got = {r.id: r.place for r in splits.limit_then_shard(df, ["x"], most, 3, shard).collect()}
        assert got == {k: i for i, k in enumerate(ordered) if i % 3 == shard}
