"""Streams agree with the batch fold; staged runs stop, resume and guard their inputs."""

from __future__ import annotations

import pytest

from sparkloom.plans import lifecycle
from sparkloom.streaming import sessions


def test_stream_grades_equal_the_batch(spark, tmp_path):
    rows = [(s, i, (s + i) % 5 - 1.0, f"2024-01-01 00:00:{i:02}") for s in range(6) for i in range(9)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], "session long, step long, reward double, ts string").selectExpr("session", "step", "reward", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(sessions.STEP).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: dict[int, tuple] = {}

    def keep(df, _):
        seen.update({r.session: (r.steps, round(r.total_reward, 9), r.passed) for r in df.collect()})

    query = sessions.stream_grades(source, ttl_seconds=0).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    batch = sessions.grade(spark.read.parquet(str(tmp_path / "in")))
    assert seen == {r.session: (r.steps, round(r.total_reward, 9), r.passed) for r in batch.collect()}


def test_stream_sessions_by_event_time(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "u long, ts string").selectExpr("u", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("u long, ts timestamp").parquet(str(tmp_path / "in"))
    query = sessions.session_windows(source, "u", "ts", "30 minutes", "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert sorted((r.u, r.events) for r in spark.table("windows").collect()) == [(1, 1), (1, 2), (2, 1)]


def plan(tmp_path, **more):
    (tmp_path / "in.txt").write_text("x")
    return lifecycle.Plan("p", ["validate_data", "make"], {"data": str(tmp_path / "in.txt")}, {"seed": 1}, **more)


def test_runs_resume_and_skip_what_is_done(tmp_path):
    done: list[str] = []

    def make(p):
        done.append("make")
        (tmp_path / "out.txt").write_text("y")
        if len(done) == 1:
            raise RuntimeError("boom")
        return {"out": str(tmp_path / "out.txt")}

    actions = {"validate_data": lambda p: None, "make": make}
    first = plan(tmp_path)
    assert lifecycle.run(first, str(tmp_path / "r"), actions, dry=True).state == "planned" and not (tmp_path / "r").exists()
    with pytest.raises(RuntimeError):
        lifecycle.run(first, str(tmp_path / "r"), actions)
    assert lifecycle.load(str(tmp_path / "r/p.manifest.json")).state == "failed"
    with pytest.raises(FileExistsError):
        lifecycle.run(first, str(tmp_path / "r"), actions)
    again = plan(tmp_path, resume=True)
    assert again.digest() == first.digest() and lifecycle.run(again, str(tmp_path / "r"), actions).state == "completed"
    with pytest.raises(ValueError, match="can't become"):
        lifecycle.run(again, str(tmp_path / "r"), actions)


def test_changed_inputs_and_plans_are_refused(tmp_path):
    p = plan(tmp_path)
    with pytest.raises(ValueError, match="changed"):
        lifecycle.run(p, str(tmp_path / "r"), {"validate_data": lambda q: (tmp_path / "in.txt").write_text("z") and None, "make": lambda q: None})
    with pytest.raises(ValueError, match="differ"):
        lifecycle.run(lifecycle.Plan("p", ["validate_data", "make"], p.inputs, {"seed": 2}, True), str(tmp_path / "r"), {"validate_data": lambda q: None, "make": lambda q: None})
    assert lifecycle.Plan("a/b", ["x", "x"], {"a": "/d", "b": "/d/e"}).faults() and lifecycle.scrub({"a": [{"my_token": 1}], "b": 2}) == {"a": [{"my_token": "[redacted]"}], "b": 2}


def test_the_entry_works_without_the_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).parent.parent
    shutil.copytree(here / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'leakage_near' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
