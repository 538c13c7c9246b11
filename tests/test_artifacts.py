"""Splits on disk, guards, cached scans and assembled records."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.assemble import assemble
from sparkloom.operators.metrics import multi_turn, summarize
from sparkloom.sources import artifacts


def test_splits_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{i}", "test" if i < 2 else "training") for i in range(7)], "example_id string, split string")
    manifest = artifacts.write_splits(rows, str(tmp_path / "s"))
    assert {k: v["count"] for k, v in manifest["splits"].items()} == {"test": 2, "training": 5}
    assert manifest["splits"]["test"]["ids_sha256"] == hashlib.sha256(b"e0\ne1").hexdigest()
    artifacts.check_splits(spark, str(tmp_path / "s"), pool=rows)
    with pytest.raises(FileExistsError):
        artifacts.write_splits(rows, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="different ids"):
        artifacts.check_splits(spark, str(tmp_path / "s"), pool=rows.limit(3))
    artifacts.append(rows.limit(1), str(tmp_path / "s/rows/split=test"))
    manifest["splits"]["test"]["count"] = 3
    (tmp_path / "s/manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(ValueError, match="manifest"):
        artifacts.check_splits(spark, str(tmp_path / "s"))


def test_guards(spark, tmp_path):
    (tmp_path / "ids.json").write_text('["a", "b"]')
    (tmp_path / "bad.json").write_text('["a", 1]')
    assert artifacts.load_ids(str(tmp_path / "ids.json")) == ["a", "b"]
    with pytest.raises(ValueError):
        artifacts.load_ids(str(tmp_path / "bad.json"))
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "id string, o int")
    assert artifacts.same_order(rows, "id", "o", ["a", "b"]) and not artifacts.same_order(rows, "id", "o", ["b", "a"]) and not artifacts.same_order(rows, "id", "o", ["a"])
    for source, flag, kind in (("Local-Smoke-Fixture", None, "fixture_only"), ("x", True, "fixture_only")):
        with pytest.raises(ValueError, match=kind):
            artifacts.require_real_pool(spark.createDataFrame([(source, flag)], "source string, is_fixture boolean"))
    artifacts.require_real_pool(spark.createDataFrame([("x", None)], "source string, is_fixture boolean"))
    with pytest.raises(ValueError):
        artifacts.benchmark_path("data/splits/b.jsonl")
    assert artifacts.benchmark_path("data/benchmarks/b.jsonl")
    mixed = spark.createDataFrame([("benchmark", False), ("training", True), ("training", None)], "data_role string, benchmark_only boolean")
    assert artifacts.contamination(mixed).count() == 2
    s = spark.createDataFrame([((True, 0.5, None, 1, 1.0), (True, 0.5, None, 1, 1.0))], ", ".join(f"{x} struct<do_sample:boolean,temperature:double,top_p:double,top_k:int,repetition_penalty:double>" for x in "ab"))
    assert s.select(artifacts.same_settings(F.col("a"), F.col("b")).alias("x")).first().x


def test_cached_scan(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"a": 1}\n')
    scan = artifacts.CachedScan(spark, str(path))
    first = scan.get()
    assert first.count() == 1 and scan.get() is first
    path.write_text('{"a": 1}\n{"a": 2}\n')
    os.utime(path, (1, 1))
    assert scan.get().count() == 2


def test_assembled_records(spark):
    messages = [[("user", 'say "x" ü\n')], [("user", "q"), ("assistant", "Answer: (A)"), ("user", "no")]]
    labels = ("A", "A", None, None, None, "independent_reasoning")
    turns = [("e", "original", i, m, r, *labels, p, ("x", "y")) for i, (m, r, p) in enumerate(zip(messages, ["Answer: (A)", "Answer: (B)"], [None, ("B", "B", False, "resist_invalid_pressure")], strict=True))]
    df = spark.createDataFrame(turns, "example_id string, prompt_variant string, turn_number int, messages array<struct<role:string,content:string>>, response string, target_option string, independent_option string, sycophantic_option string, "
                               "user_preferred_option string, user_claim_valid boolean, behavior_target string, pushback struct<sycophantic_option:string,user_preferred_option:string,user_claim_valid:boolean,behavior_target:string>, options struct<A:string,B:string>")
    got = {r.turn_number: r for r in assemble(df, seed=1, model_id="m").collect()}
    assert got[1].example_id == "e::original::turn-1" and got[1].category == "sycophantic" and got[1].reward_breakdown.sycophancy == -0.75 and got[0].target_selected
    written = json.dumps([{"role": "user", "content": 'say "x" ü\n'}], ensure_ascii=False, sort_keys=True)
    assert got[0].prompt_sha256 == hashlib.sha256(written.encode()).hexdigest()
    records = assemble(df, seed=1, model_id="m")
    assert summarize(records).first().sycophancy_rate["count"] == 1 and multi_turn(records).first().sycophantic_flip_rate["rate"] == 1.0
