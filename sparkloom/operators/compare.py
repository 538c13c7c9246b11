"""Runs side by side: fairness checks by one full outer join, paired tests, re-scoring, capability gates, ablations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.answers import classify_answer
from sparkloom.functions.scoring import profile, score
from sparkloom.operators.metrics import paired, summarize

#: What two runs must have in common for each example.
PROVENANCE = (
    "source_example_id", "source", "source_revision", "base_question_id", "benchmark_sha256", "seed", "system_prompt_condition",
    "prompt_variant", "turn_number", "model_id", "model_revision", "target_option", "independent_option", "sycophantic_option",
    "user_preferred_option", "user_claim_valid", "question_type", "behavior_target",
)
#: Names of a task's score, the preferred first.
SCORES = ("acc_norm,none", "acc,none", "exact_match,strict-match", "f1,none")


def fairness(baseline: DataFrame, candidate: DataFrame, settings: str = "generation_settings", prompt: str = "prompt_sha256") -> DataFrame:
    """One row: rows on one side only, repeated ids, and examples whose prompt, settings or provenance differ (null equals
    null, null differs from any value)."""
    both = [c for c in PROVENANCE if c in baseline.columns or c in candidate.columns]

    def side(df: DataFrame, name: str) -> DataFrame:
        has = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        setup = F.to_json(settings) if settings in df.columns and df.schema[settings].dataType.typeName() in ("struct", "map") else has(settings)
        return df.groupBy(F.col("example_id").cast("string").alias("k")).agg(
            F.count("*").alias(f"n_{name}"), F.first(F.struct(has(prompt).alias("prompt"), setup.alias("settings"), F.struct(*(has(c).alias(c) for c in both)).alias("provenance"))).alias(name))

    j = side(baseline, "x").join(side(candidate, "y"), "k", "full_outer")
    pair = F.col("x").isNotNull() & F.col("y").isNotNull()
    off = lambda f: F.count_if(pair & ~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")))
    return j.agg(F.count("*").alias("examples"), F.count_if(~pair).alias("unmatched"), F.count_if((F.col("n_x") > 1) | (F.col("n_y") > 1)).alias("repeated"),
                 off("prompt").alias("prompts_differ"), off("settings").alias("settings_differ"), off("provenance").alias("provenance_differs"))


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row of both runs' rates, their differences and the paired test; an unfair pair of runs raises."""
    fair = fairness(baseline, candidate)
    f = F.col
    wrong = (F.when(f("repeated") > 0, "duplicate example ids").when((f("unmatched") > 0) | (f("prompts_differ") > 0), "example ids or prompts differ between runs")
             .when(f("settings_differ") > 0, "generation settings differ between runs").when(f("provenance_differs") > 0, "provenance differs between runs"))
    checked = fair.where(F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).isNull())).select(f("examples").alias("matched_prompt_count"))
    names = ("target_rate", "sycophancy_rate", "invalid_answer_rate", "average_reward")
    rate_of = lambda c: f(c) if c == "average_reward" else f(f"{c}.rate")
    side = lambda df, name: summarize(df).select(*(rate_of(c).alias(f"{name}_{c}") for c in names), *([f("primary_target_metric")] if name == "baseline" else []))
    out = checked.crossJoin(side(baseline, "baseline")).crossJoin(side(candidate, "candidate")).crossJoin(paired(baseline, candidate))  # one row each
    return out.withColumns({f"delta_{c}": f(f"candidate_{c}") - f(f"baseline_{c}") for c in names})


def rescore(records: DataFrame, reward_profile: str = "combined", parser_revision: str = "1") -> DataFrame:
    """records with everything that follows from a saved response computed anew; options, earlier answers and user texts
    take no part, so that rewards can differ from those of the run itself."""
    made = ("parsed_label", "parse_status", "category", "target_selected", "format_compliant", "contradictory", "truncated", "reward", "reward_breakdown", "rescoring")
    prompt = None
    if "prompt" in records.columns:
        kind = records.schema["prompt"].dataType.typeName()
        prompt = F.array_join(F.transform("prompt", lambda m: m["content"]), "\n") if kind == "array" else F.col("prompt")
    base = records.drop("reward", "parsed")
    scored = score(base, profile(reward_profile), response="generated_response", finish_reason="finish_reason" if "finish_reason" in base.columns else None, question=prompt)
    p = F.col("parsed")
    new: dict[str, Column] = {
        "parsed_label": p["label"], "parse_status": p["reason"], "category": classify_answer(p, F.col("independent_option"), F.col("sycophantic_option")),
        "target_selected": F.coalesce(p["label"] == F.col("target_option"), F.lit(False)), "format_compliant": p["format_compliant"], "contradictory": p["contradictory"], "truncated": p["truncated"],
        "reward_breakdown": F.col("reward"), "reward": F.col("reward.total"),
        "rescoring": F.struct(F.lit(parser_revision).alias("parser_revision"), F.lit(True).alias("post_hoc"), F.lit(reward_profile).alias("reward_profile"))}
    kept = [c for c in records.columns if c not in made]
    return scored.select(*kept, *(v.alias(k) for k, v in new.items()))


def capability_scores(results: DataFrame, task: str = "task", metrics: str = "metrics") -> DataFrame:
    """task and its preferred numeric score; tasks without one go. metrics: a map of names to numbers."""
    return results.select(F.col(task).alias("task"), F.coalesce(*(F.try_element_at(F.col(metrics), F.lit(s)) for s in SCORES)).cast("double").alias("score")).where("score is not null")


def compare_capabilities(baseline: DataFrame, candidate: DataFrame, most_lost: float) -> DataFrame:
    """task, both scores, delta and passed (no more than most_lost below); tasks of one side only raise."""
    j = baseline.select("task", F.col("score").alias("baseline")).join(candidate.select("task", F.col("score").alias("candidate")), "task", "full_outer")
    alone = F.col("baseline").isNull() | F.col("candidate").isNull()
    j = j.where(F.when(~alone, F.lit(True)).otherwise(F.raise_error(F.lit("capability comparison requires identical tasks")).isNull()))
    delta = F.col("candidate") - F.col("baseline")
    return j.select("task", "baseline", "candidate", delta.alias("delta"), (delta >= -most_lost).alias("passed"))


def require_capabilities(compared: DataFrame) -> None:
    """Raises where a task of compare_capabilities lost more than it may, naming the tasks: what stops a run."""
    if lost := sorted(r.task for r in compared.where(~F.col("passed")).select("task").collect()):
        raise ValueError(f"capabilities were lost: {', '.join(lost)}")


def ablation(records: DataFrame, run: str, describe: Sequence[str] = ("model_id", "adapter_path", "system_prompt_condition"), order: str = "example_id") -> DataFrame:
    """A row a run: what its first record says of the run, and its rates; fewer than two runs raise."""
    first = records.groupBy(run).agg(*(F.min_by(c, order).alias(c) for c in describe if c in records.columns))
    s = summarize(records, [run]).select(run, F.col("total_examples").alias("examples"), F.col("primary_target_metric").alias("target_metric"), F.col("target_rate.rate").alias("target_rate"), F.col("sycophancy_rate.rate").alias("sycophancy_rate"),
                                         F.col("invalid_answer_rate.rate").alias("invalid_rate"), F.col("required_format_compliance_rate.rate").alias("format_compliance_rate"), "average_reward")
    runs = s.agg(F.count("*").alias("__runs"))
    both = first.join(s, run).crossJoin(runs)
    return both.where(F.when(F.col("__runs") >= 2, F.lit(True)).otherwise(F.raise_error(F.lit("at least two runs are required")).isNull())).drop("__runs")


def errors(records: DataFrame, each: int = 5) -> DataFrame:
    """category, rank and the record, for at most each records of a category by id. A record is in its own category and in
    those of its faults."""
    from pyspark.sql import Window

    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("boolean")
    kinds = F.array_compact(F.array(
        F.coalesce(F.col("category"), F.lit("invalid")), F.when(has("contradictory"), "contradictory"), F.when(has("truncated"), "truncated"), F.when(has("format_compliant").eqNullSafe(False), "format_failure"),
        F.when(has("user_claim_valid").eqNullSafe(True) & ~F.coalesce(has("target_selected"), F.lit(False)), "unnecessary_disagreement")))
    rows = records.withColumn("error_category", F.explode(kinds))
    rank = F.row_number().over(Window.partitionBy("error_category").orderBy(F.col("example_id").cast("string")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= each)


def errors_markdown(picked: DataFrame) -> str:
    """errors() as a report: a bounded number of records a category."""
    lines, last = ["# Error Analysis", ""], None
    for r in picked.orderBy("error_category", "rank").collect():
        d = r.asDict()
        if d["error_category"] != last:
            last = d["error_category"]
            lines += [f"## {last.replace('_', ' ').title()}", ""]
        lines += [f"### `{d['example_id']}`", ""]
        lines += [f"- {name}: `{d.get(key)}`" for name, key in (("Parsed label", "parsed_label"), ("Parse status", "parse_status"), ("Target option", "target_option"), ("Reward", "reward"))]
        lines += ["", "**Response**", "", "```text", str(d.get("generated_response", "")), "```", ""]
    return "\n".join(lines)


def resume(planned: DataFrame, done: DataFrame, key: str = "example_id", same: Sequence[str] = ()) -> DataFrame:
    """The planned rows that aren't done; a done row that was made under another of the same columns raises."""
    if same:
        off = done.select(key, *(F.col(c).alias(f"__{c}") for c in same)).join(planned.select(key, *same), key)
        bad = F.lit(False)
        for c in same:
            bad = bad | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        if not off.where(bad).isEmpty():
            raise ValueError("completed rows were made under other settings")
    return planned.join(done.select(key), key, "left_anti")
