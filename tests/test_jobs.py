"""Jobs over files, end to end on small ones."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom import tables
from sparkloom.operators import metrics, rollout
from sparkloom.plans import jobs
from sparkloom.sources import artifacts

QUESTIONS = (
    "What is the boiling point of water at sea level", "Who wrote the play about the prince of Denmark", "Which planet has the most moons today", "How many legs does a spider have",
    "What colour do you get from blue and yellow", "Which ocean lies between Europe and America", "When did the first people land on the moon", "Which metal is liquid at room temperature",
    "What is the capital city of Australia", "Which animal is the fastest on land", "How many strings has a violin", "What gas do plants take from the air",
)


def csv(path, rows):
    path.write_text("id,question,option_a,option_b,answer,user_preferred_option\n" + "".join(",".join(r) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def choices():
    return [(f"q{i}", q, f"yes {i}", f"no {i}", "AB"[i % 2], "AB"[i // 2 % 2]) for i, q in enumerate(QUESTIONS)]


def test_import_of_a_simple_table(spark, tmp_path):
    source = csv(tmp_path / "in.csv", choices())
    target = jobs.import_user_dataset(spark, source, "mine", str(tmp_path / "out"), "ns")
    manifest = json.loads((tmp_path / "out/mine/import_manifest.json").read_text())
    assert manifest["input_format"] == "simple-choice" and manifest["normalized_rows"] == 12
    artifacts.check_splits(spark, f"{target}/splits", role="data_role", pool=spark.read.json(f"{target}/training_pool"))
    found = {r.data_role: r["count"] for r in spark.read.json(f"{target}/splits/rows").groupBy("data_role").count().collect()}
    assert sum(found.values()) == 12 and set(found) == {"training", "validation", "test"}
    with pytest.raises(FileExistsError):
        jobs.import_user_dataset(spark, source, "mine", str(tmp_path / "out"), "ns")
    for name, kind, license_id in (("../x", "auto", "x"), ("ok", "table", "x"), ("ok", "auto", " ")):
        with pytest.raises(ValueError):
            jobs.import_user_dataset(spark, source, name, str(tmp_path / "out"), "ns", kind, license_id=license_id)


def canonical_row(i, **more):
    return {"example_id": f"c{i}", "prompt": [{"role": "user", "content": QUESTIONS[i]}], "target_option": "A", "independent_option": "A"} | more


@pytest.mark.parametrize("suffix", ["json", "jsonl"])
def test_import_of_canonical_rows(spark, tmp_path, suffix):
    rows = [canonical_row(i) for i in range(12)]
    path = tmp_path / f"in.{suffix}"
    path.write_text(json.dumps(rows) if suffix == "json" else "\n".join(map(json.dumps, rows)))
    target = jobs.import_user_dataset(spark, str(path), "mine", str(tmp_path / "out"), "ns")
    pool = {r.example_id: r for r in spark.read.json(f"{target}/training_pool").collect()}
    assert len(pool) == 12 and pool["c3"].source == "user/mine" and json.loads(pool["c3"].metadata)["source_row_index"] == 3


def test_a_faulty_import_leaves_nothing(spark, tmp_path):
    for i, bad in enumerate(({"data_role": "benchmark"}, {"metadata": {"benchmark_only": True}}, {"target_option": "C"}, {"prompt": [{"role": "user", "content": QUESTIONS[0].upper()}]}, {"example_id": "c0"})):
        path = tmp_path / f"{i}.jsonl"
        path.write_text("\n".join(json.dumps(canonical_row(k, **(bad if k == 1 else {}))) for k in range(12)))
        with pytest.raises(Exception):
            jobs.import_user_dataset(spark, str(path), "mine", str(tmp_path / "out"), "ns")
        assert not (tmp_path / "out/mine").exists()


def test_near_duplicate_questions_are_not_split(spark, tmp_path):
    rows = choices()
    rows.append(("q99", rows[0][1] + "s", "a", "b", "A", "A"))
    with pytest.raises(ValueError, match="near-duplicate questions q0 and q99"):
        jobs.import_user_dataset(spark, csv(tmp_path / "in.csv", rows), "mine", str(tmp_path / "out"), "ns")


def record(i, response, reward):
    return {"example_id": f"e{i}", "prompt_sha256": "p", "generation_settings": {"temperature": 0.0}, "generated_response": response, "finish_reason": "eos", "target_option": "A", "independent_option": "A",
            "sycophantic_option": "B", "user_preferred_option": "B", "user_claim_valid": False, "behavior_target": "resist_invalid_pressure", "question_type": "objective", "category": "sycophantic",
            "target_selected": False, "reward": reward}


def test_archive_is_scored_anew_and_compared(spark, tmp_path):
    archive = tmp_path / "run.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for phase, good in (("before", 2), ("after", 5)):
            lines = [record(i, "Answer: (A)\nReason: the premise is sound." if i < good else "Answer: (B)", 0.0) for i in range(6)]
            z.writestr(f"x/{phase}/responses.jsonl", "\n".join(map(json.dumps, lines)) + "\n")
    report = jobs.rescore_archive(spark, str(archive), str(tmp_path / "out"))
    assert report["original"]["after"]["target_rate"]["count"] == 0 and report["revised"]["after"]["target_rate"]["count"] == 5
    assert report["revised"]["comparison"]["candidate_only_correct"] == 3 and json.loads((tmp_path / "out/rescore_report.json").read_text())["post_hoc"]
    paths = [str(tmp_path / f"out/{p}.responses.rescored") for p in ("before", "after")]
    assert jobs.compare_from_paths(spark, *paths, str(tmp_path / "c.json"))["matched_prompt_count"] == 6


def test_report_over_seeds(spark, tmp_path):
    paths = []
    for i, value in enumerate((0.2, 0.4, 0.6)):
        one = {"primary_target_metric": "target_accuracy", "target_rate": {"rate": value}, "sycophancy_rate": {"rate": 0.1}, "invalid_answer_rate": {"rate": 0.0}, "average_reward": None if i else 1.0}
        paths.append(str(tmp_path / f"{i}.json"))
        (tmp_path / f"{i}.json").write_text(json.dumps(one))
    got = jobs.multi_seed_report(spark, paths, str(tmp_path / "out.json"))
    assert got["metrics"]["target_accuracy"]["mean"] == pytest.approx(0.4) and got["metrics"]["average_reward"]["values"] == [1.0] and got["seed_count"] == 3
    with pytest.raises(ValueError, match="three"):
        jobs.multi_seed_report(spark, paths[:2])
    (tmp_path / "2.json").write_text(json.dumps({"independent_choice_rate": {"rate": 1}}))
    with pytest.raises(ValueError, match="differ in meaning"):
        jobs.multi_seed_report(spark, paths)


def test_reset_picks_one_and_hides_labels(spark):
    rows = spark.createDataFrame([(f"e{i}", "p", f"t{i % 2}", "s", "objective", "A") for i in range(9)], "example_id string, prompt string, topic string, source string, question_type string, target_option string")
    got = jobs.reset(rows, category="t1").collect()
    assert len(got) == 1 and got[0].episode_id in {"e1", "e3", "e5", "e7"} and "target_option" not in got[0].asDict() and got[0].total_turns == 1
    assert got == jobs.reset(rows.repartition(4), category="t1").collect() and jobs.reset(rows, example_id="no").isEmpty()
    assert jobs.reset(rows, category="s", example_id="e4").first().episode_id == "e4"


def test_completions_and_identities(spark):
    df = spark.createDataFrame([([{"role": "user", "content": "x", "id": "a", "part": "training"}],), ([{"role": "user", "content": None, "id": "a", "part": "training"}],), ([],), (None,),
                                ([{"role": "user", "content": "x", "id": None, "part": None}],), ([{"role": "user", "content": "x", "id": "a", "part": "test"}],)], "p array<struct<role:string,content:string,id:string,part:string>>")
    got = rollout.identified(df, "p", "id", "part").collect()
    assert [r.fault is None for r in got] == [True, False, False, False, False, False] and got[0].messages[0].asDict() == {"role": "user", "content": "x"}
    texts = df.select(rollout.completion_text(F.col("p"), "messages").alias("t")).collect()
    assert [r.t for r in texts] == ["x", "", "", "", "x", "x"]
    assert {(r.label, r.n) for r in metrics.choice_distribution(spark.createDataFrame([("A",), ("A",), (None,)], "target_option string")).collect()} == {("A", 2), (None, 1)}


def test_places_are_gapless(spark):
    got = tables.numbered(spark.range(50).repartition(7), "place").collect()
    assert sorted(r.place for r in got) == list(range(50))
    assert jobs.ranked_errors(spark.range(5).toDF("example_id"), spark.range(2, 4).toDF("example_id"), most=2) == {"left": [0, 1], "right": []}
