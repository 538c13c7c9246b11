"""Jobs over files, each a composition of operators: import of a user's table, splits, comparisons, archives, seeds."""

from __future__ import annotations

import json
import re
import shutil
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sparkloom.operators import compare, identity, metrics, similarity, splits
from sparkloom.sources import artifacts, canonical, records
from sparkloom.tables import numbered

#: Names that a folder may have, and the layouts of a user's table.
SAFE_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")
LAYOUTS = ("auto", "simple-choice", "canonical")
SEEDED = ("sycophancy_rate", "invalid_answer_rate")


def split_examples(rows: DataFrame, seed: int = 42, validation_fraction: float = 0.15, test_fraction: float = 0.15, threshold: float = 0.94) -> DataFrame:
    """Canonical rows with data_role (training, validation or test) and split_group, whole groups of a question together.

    Repeated ids, prompts that are equal but for case and spaces, and groups whose questions are near duplicates raise, the
    error naming the first by id."""
    if min(validation_fraction, test_fraction) <= 0 or validation_fraction + test_fraction >= 1:
        raise ValueError("validation and test fractions must be positive and less than 1 together")
    said = canonical.prompt_text(F.col("prompt"))
    whole = rows.withColumns({"__print": identity.fingerprint(said), "split_group": identity.question_group(F.col("question_id"), said), "__asked": identity.question_text(F.col("question_text"), said)})
    if repeated := identity.duplicates(whole, F.col("example_id"), "example_id").orderBy("first_id").first():
        raise ValueError(f"duplicate example_id {repeated.key}")
    if repeated := identity.duplicates(whole, F.col("__print"), "example_id").orderBy("first_id").first():
        raise ValueError(f"{repeated.copies} prompts are equal to that of {repeated.first_id}")
    near = similarity.near_duplicate_groups(whole, "split_group", "__asked", "example_id", threshold).orderBy("left_group", "right_group").first()
    if near:
        raise ValueError(f"near-duplicate questions {near.left_group} and {near.right_group} (similarity {near.similarity:.3f}): give them one question_id")
    dealt = splits.split_rows(whole, "split_group", seed=seed, validation_fraction=validation_fraction, test_fraction=test_fraction)
    if not identity.overlap(dealt, "__print", "split").isEmpty():
        raise ValueError("a prompt is in two splits")
    return dealt.withColumn("data_role", F.col("split")).drop("__print", "__asked", "split")


def layout(rows: DataFrame) -> str:
    """canonical where prompts are lists, else simple-choice."""
    return "canonical" if "prompt" in rows.columns and isinstance(rows.schema["prompt"].dataType, ArrayType) else "simple-choice"


def canonical_lines(spark: SparkSession, path: str, dataset: str, revision: str) -> DataFrame:
    """value: the rows of a .json or .jsonl file as lines of the pool, with what an import sets: training as the role (any
    other raises), a source, its revision, the row's number and question in the metadata. Rows that only a benchmark may
    have raise."""
    name = Path(path).name.lower()
    lines = spark.read.text(path, wholetext=name.endswith(".json")).select("value")

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, value in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                found = json.loads(value) if value.strip() else []
                for j, row in enumerate(found if isinstance(found, list) else [found]):
                    meta = row.get("metadata", {})
                    if row.get("data_role", "training") != "training":
                        raise ValueError(f"row {i + j + 1} has data_role {row['data_role']!r}; imports are for training")
                    if not isinstance(meta, dict) or meta.get("benchmark_only"):
                        raise ValueError(f"row {i + j + 1}: metadata must be an object without benchmark_only")
                    meta = {"question_id": row.get("example_id"), **meta, "source_row_index": i + j, "benchmark_only": False}
                    out.append(json.dumps({"source": f"user/{dataset}", "source_revision": revision, **row, "data_role": "training", "metadata": meta}, ensure_ascii=False))
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    return numbered(lines, "place").mapInArrow(rewritten, "value string")


def import_user_dataset(spark: SparkSession, path: str, dataset: str, root: str, namespace: str, table_layout: str = "auto", seed: int = 42, validation_fraction: float = 0.15,
                        test_fraction: float = 0.15, license_id: str = "other", source_url: str | None = None, governance: canonical.Governance | None = None) -> str:
    """A user's .csv, .json or .jsonl as a pool of training rows with splits and a manifest, below root/dataset.

    A faulty row raises, as do an unsafe name, an unknown layout, a blank license and a folder that exists; a folder that
    isn't finished is removed."""
    if not SAFE_NAME.fullmatch(dataset):
        raise ValueError("a dataset's name has 1 to 64 letters, digits, dots, dashes and underscores and starts with a letter or digit")
    if table_layout not in LAYOUTS:
        raise ValueError(f"the layout must be one of {LAYOUTS}")
    if not license_id.strip():
        raise ValueError("the license must not be blank")
    target = Path(root, dataset)
    if target.exists():
        raise FileExistsError(target)
    rows, revision = records.read_table(spark, path), records.file_digest(path)
    kind = layout(rows) if table_layout == "auto" else table_layout
    if kind == "canonical":
        pool = canonical.validate(canonical_lines(spark, path, dataset, revision), "value", "training", governance).drop("value", "row")
        pool = pool.withColumn("metadata", F.col("metadata").cast("string"))
    else:
        pool = records.simple_choices(numbered(rows, "source_row_index"), dataset, namespace).withColumn("source_revision", F.lit(revision))
    pool = canonical.accept(pool)
    try:
        records.write_records(pool.orderBy("example_id"), f"{target}/training_pool")
        artifacts.write_splits(split_examples(pool, seed, validation_fraction, test_fraction), f"{target}/splits", role="data_role", seed=seed, source=path)
        records.write_json(f"{target}/import_manifest.json", {
            "schema_version": 1, "dataset_name": dataset, "input_path": str(Path(path).resolve()), "input_format": kind, "input_sha256": revision,
            "normalized_rows": pool.count(), "seed": seed, "validation_fraction": validation_fraction, "test_fraction": test_fraction, "license": license_id.strip(),
            "source_url": source_url, "outputs": {"training_pool": "training_pool", "splits": "splits"}})
    except BaseException:
        shutil.rmtree(target, ignore_errors=True)
        raise
    return str(target)


def _report(row) -> dict:
    return row.asDict(recursive=True)


def compare_from_paths(spark: SparkSession, baseline: str, candidate: str, output: str | None = None) -> dict:
    """The paired comparison of two files of records, written to output if one is named."""
    report = _report(compare.compare_runs(records.read_records(spark, baseline), records.read_records(spark, candidate)).first())
    if output:
        records.write_json(output, report)
    return report


def rescore_archive(spark: SparkSession, archive: str, output: str, reward_profile: str = "combined") -> dict:
    """The records before and after training of a ZIP, scored anew: both written below output, with a report of the
    summaries as they were and are and the paired comparison. The archive stays as it is."""
    found, report = {}, {"post_hoc": True, "publishable_as_original_preregistered_result": False, "source_archive": str(Path(archive).resolve()), "source_archive_sha256": records.file_digest(archive),
                         "reward_profile": reward_profile, "original": {}, "revised": {}}
    for phase in ("before", "after"):
        lines = records.archive_lines(spark, archive, phase).select("value")
        original = spark.read.json(lines.rdd.map(lambda r: r.value))  # the one way to read lines of a column as a table of their own schema
        found[phase] = compare.rescore(original, reward_profile)
        report["original"][phase] = _report(metrics.summarize(original).first())
        report["revised"][phase] = _report(metrics.summarize(found[phase]).first())
    report["revised"]["comparison"] = _report(compare.compare_runs(found["before"], found["after"]).first())
    for phase, rows in found.items():
        records.write_records(rows, f"{output}/{phase}.responses.rescored")
    records.write_json(f"{output}/rescore_report.json", report)
    return report


def multi_seed_report(spark: SparkSession, summaries: Sequence[str], output: str | None = None) -> dict:
    """Mean, deviation and values over the JSON summaries of three runs or more, which must share the target's meaning."""
    if len(summaries) < 3:
        raise ValueError("at least three completed summaries are required")
    read = [json.loads(Path(p).read_text(encoding="utf-8")) for p in summaries]
    names = {str(s.get("primary_target_metric") or ("independent_choice_rate" if "independent_choice_rate" in s else "target_accuracy")) for s in read}
    if len(names) != 1:
        raise ValueError(f"the summaries' targets differ in meaning: {sorted(names)}")
    target = names.pop()
    of = lambda s, name: (s.get(name) or s.get("target_rate") or {}).get("rate") if name == target else s["average_reward"] if name == "average_reward" else s[name]["rate"]
    rows = [(name, i, None if (v := of(s, name)) is None else float(v)) for i, s in enumerate(read) for name in (target, *SEEDED, "average_reward")]
    got = metrics.over_seeds(spark.createDataFrame(rows, "metric string, seed long, value double")).collect()
    report = {"seed_count": len(read), "metrics": {r.metric: {"mean": r.mean, "std": r["std"], "values": r["values"]} for r in got}, "source_summaries": list(summaries)}
    if output:
        records.write_json(output, report)
    return report


def reset(examples: DataFrame, category: str | None = None, example_id: str | None = None, seed: int = 42) -> DataFrame:
    """One episode to start: of the examples of a category (a topic or a source) or of that id, the first of the drawn order.
    Labels aren't shown. No row: none matches."""
    some = examples
    if category is not None:
        some = some.where((F.col("topic") == category) | (F.col("source") == category))
    if example_id is not None:
        some = some.where(F.col("example_id") == example_id)
    drawn = some.withColumn("__h", splits.draw_key(F.col("example_id"), seed)).orderBy("__h", "example_id").limit(1)
    turns = F.size(F.coalesce("pushback_turns", F.array().cast(examples.schema["pushback_turns"].dataType))) + 1 if "pushback_turns" in examples.columns else F.lit(1)
    return drawn.select(F.col("example_id").alias("episode_id"), "prompt", F.lit(0).alias("turn_number"), "source", "question_type", turns.alias("total_turns"))


def ranked_errors(baseline: DataFrame, candidate: DataFrame, key: str = "example_id", most: int = 3) -> dict[str, list]:
    """The first ids, at most so many, that only one of two tables has: what an error tells."""
    sides = identity.same_ids(baseline, candidate, key)
    place = F.row_number().over(Window.partitionBy("side").orderBy(key))
    got = sides.withColumn("__p", place).where(F.col("__p") <= most).orderBy("side", key).collect()
    return {side: [r[key] for r in got if r.side == side] for side in ("left", "right")}
