"""Evaluation records from examples, the turns asked and the responses given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.answers import classify_answer, parse_answer
from sparkloom.functions.scoring import COMBINED, SUBJECTIVE, Weights, score
from sparkloom.sources.artifacts import prompt_digest

CONTEXT = ("target_option", "independent_option", "sycophantic_option", "user_preferred_option", "user_claim_valid", "behavior_target")


def assemble(turns: DataFrame, weights: Weights = COMBINED, **run: object) -> DataFrame:
    """Records of turns: example_id, prompt_variant, turn_number, messages (the chat so far), response, the example's labels,
    and pushback, a struct of what the turn's pushback states (null on the first turn). run: model, seed and settings.

    The pushback's labels win where it states them; base_question_id falls back to question_id and the example; the last
    assistant message, parsed without regard to truncation, is the earlier answer."""
    has = set(turns.schema["pushback"].dataType.fieldNames()) if "pushback" in turns.columns else set()
    have = lambda c, kind="string": F.col(c) if c in turns.columns else F.lit(None).cast(kind)
    stated = {c: F.coalesce(F.col(f"pushback.{c}"), F.col(c)) for c in CONTEXT if c in has and c in turns.columns}
    rows = turns.withColumns(stated)
    said: Column = F.filter("messages", lambda m: m["role"] == "user")
    prior = F.try_element_at(F.filter("messages", lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    rows = rows.withColumns({"__prior": parse_answer(prior)["label"], "__heard": F.transform(said, lambda m: m["content"]), "behavior_target": F.coalesce("behavior_target", F.lit("independent_reasoning"))})
    asked = F.array_join(F.transform("messages", lambda m: m["content"]), "\n")
    scored = score(rows, weights, response="response", finish_reason="finish_reason" if "finish_reason" in rows.columns else None, question=asked, options="options" if "options" in rows.columns else None,
                   previous_answer=F.col("__prior"), user_texts=F.col("__heard"), subjective=F.coalesce(have("question_type").isin(*SUBJECTIVE), F.lit(False)))
    p, episode = F.col("parsed"), F.concat_ws("::", F.col("example_id").cast("string"), "prompt_variant")
    return scored.select(
        F.concat(episode, F.lit("::turn-"), F.col("turn_number").cast("string")).alias("example_id"), F.col("example_id").alias("source_example_id"), episode.alias("episode_id"), "turn_number", have("source").alias("source"),
        have("source_revision").alias("source_revision"), F.coalesce(F.nullif(have("base_question_id"), F.lit("")), F.nullif(have("question_id"), F.lit("")), F.col("example_id").cast("string")).alias("base_question_id"),
        *(F.lit(v).alias(k) for k, v in run.items()), "prompt_variant", F.col("messages").alias("prompt"), prompt_digest(F.col("messages")).alias("prompt_sha256"), F.col("response").alias("generated_response"), have("finish_reason").alias("finish_reason"),
        p["label"].alias("parsed_label"), p["reason"].alias("parse_status"), classify_answer(p, F.col("independent_option"), F.col("sycophantic_option")).alias("category"), *CONTEXT,
        F.coalesce(p["label"] == F.col("target_option"), F.lit(False)).alias("target_selected"), p["format_compliant"].alias("format_compliant"), p["contradictory"].alias("contradictory"), p["truncated"].alias("truncated"),
        F.col("reward.total").alias("reward"), F.col("reward").alias("reward_breakdown"), have("question_type").alias("question_type"), have("topic").alias("topic"), F.coalesce(have("answer_position"), F.col("independent_option")).alias("answer_position"))
