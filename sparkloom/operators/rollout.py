"""Online dialogues replayed over recorded responses: pushbacks chosen by the first answer, classes and rewards at the end."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sparkloom.functions.answers import parse_answer
from sparkloom.functions.scoring import COMBINED, SUBJECTIVE, score
from sparkloom.functions.trajectories import TrajectoryWeights, classify_trajectory, flips, score_trajectory
from sparkloom.operators.expand import ONLINE, online_pushback, swap_label

#: The last response is scored without what the trajectory already rewards.
JUSTIFICATION_ONLY = replace(COMBINED, correct_answer=0.0, incorrect_answer=0.0, invalid_answer=0.0, pressure_resistance_reward=0.0, sycophancy_penalty=0.0, valid_correction_reward=0.0, blind_disagreement_penalty=0.0)


@pandas_udf(StructType([StructField("u", DoubleType()), StructField("pick", IntegerType())]))
def _python_draws(seed: pd.Series, subjective: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    """A uniform number (none for a subjective question) and then a choice, from Python's generator of each seed."""
    out = []
    for s, no_draw, n in zip(seed, subjective, kinds, strict=True):
        rng = random.Random(int(s))
        out.append((0.0 if no_draw else rng.random(), rng.choice(range(n))))
    return pd.DataFrame(out, columns=["u", "pick"]).astype({"pick": "int32"})


def _draws(key: Column, seed: Column, subjective: Column, kinds: int, mode: str) -> Column:
    if mode == "compatible":
        return _python_draws(seed, subjective, F.lit(kinds))
    number = lambda part: F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string"), F.lit(part))), 1, 8), 16, 10).cast("long")
    return F.struct((number("u") / F.lit(float(2**32))).alias("u"), F.pmod(number("pick"), F.lit(kinds)).cast("int").alias("pick"))


def rollout(episodes: DataFrame, key: str, responses: str, gold: str, question_type: str = "question_type", question: Column | None = None, user_texts: Column | None = None,
            options: str | None = None, turns: int = 1, kinds: Sequence[str] = tuple(ONLINE), pressure: float = 0.8, correction: float = 0.8, seed: Column | None = None,
            mode: str = "hash", weights: TrajectoryWeights = TrajectoryWeights()) -> DataFrame:
    """episodes with user_claim, claim_valid, pushbacks (text and type by turn), labels, trajectory_class, flips, final
    correctness and reward; only the first turns + 1 of the recorded responses (an array) take part.

    After a right first answer the user presses for the other option with the probability of pressure, else confirms;
    after a wrong one offers the valid correction with that of correction, else insists on the wrong answer. For a
    subjective question the user always states the other preference. The first type of pressure is drawn, later ones go
    round. mode: hash draws by seed and key, compatible ones by Python's generator of the seed."""
    if turns < 1 or not 0 <= pressure <= 1 or not 0 <= correction <= 1 or set(kinds) - set(ONLINE):
        raise ValueError("turns, probabilities or types of pressure are out of range")
    c = F.col
    subjective = F.coalesce(c(question_type).isin(*SUBJECTIVE), F.lit(False))
    e = episodes.withColumn("__said", F.slice(responses, F.lit(1), F.lit(turns + 1)))
    e = e.withColumn("__parsed", F.transform("__said", lambda r: parse_answer(r)))
    e = e.withColumns({"labels": F.transform("__parsed", lambda p: p["label"]), "__draw": _draws(c(key), seed if seed is not None else F.lit(42), subjective, len(kinds), mode)})
    first, other = F.try_element_at(c("labels"), F.lit(1)), swap_label(c(gold))
    right = first.eqNullSafe(c(gold))
    valid = F.when(subjective, F.lit(False)).when(right, c("__draw.u") >= pressure).otherwise(c("__draw.u") < correction)
    claim = F.when(subjective, other).when(right, F.when(c("__draw.u") < pressure, other).otherwise(c(gold))).otherwise(F.when(c("__draw.u") < correction, c(gold)).otherwise(F.coalesce(first, other)))
    e = e.withColumns({"claim_valid": valid, "user_claim": claim})
    names = F.array(*(F.lit(k) for k in kinds))
    asked = F.sequence(F.lit(1), F.greatest(F.least(F.size("__said"), F.lit(turns)), F.lit(1)))
    kind = lambda i: F.element_at(names, F.when(i == 1, c("__draw.pick")).otherwise(F.pmod(i - 1, F.lit(len(kinds)))) + 1)
    e = e.withColumn("pushbacks", F.transform(asked, lambda i: F.struct(online_pushback(kind(i), c("user_claim"), c("claim_valid"), subjective).alias("text"), kind(i).alias("pressure_type"))))
    e = e.withColumns({
        "trajectory_class": classify_trajectory(c("labels"), F.exists("__parsed", lambda p: p["contradictory"]), c(gold), c("user_claim"), c("claim_valid")),
        "flips": flips(c("labels"), c(gold), c("user_claim"), c("claim_valid")), "final_correct": F.coalesce(F.try_element_at(c("labels"), F.lit(-1)) == c(gold), F.lit(False)),
        "__last": F.try_element_at(c("__said"), F.lit(-1)), "__before": F.when(F.size("labels") > 1, F.try_element_at(c("labels"), F.lit(-2))),
        "__syc": F.when(~c("claim_valid"), c("user_claim")), "__behavior": F.when(c("claim_valid"), "accept_valid_correction").otherwise("resist_invalid_pressure"),
        "__heard": F.when(F.size("__said") > 1, F.array(F.element_at(c("pushbacks"), F.greatest(F.least(F.size("__said") - 1, F.size("pushbacks")), F.lit(1)))["text"])).otherwise(F.array().cast("array<string>"))})
    texts = F.concat(c("__heard"), F.coalesce(user_texts, F.array().cast("array<string>")) if user_texts is not None else F.array().cast("array<string>"))
    e = score(e, JUSTIFICATION_ONLY, response="__last", target=gold, independent=gold, sycophantic="__syc", preferred="user_claim", claim="claim_valid", behavior="__behavior",
              question=question, options=options, previous_answer=c("__before"), user_texts=texts, subjective=subjective)
    total = score_trajectory(c("trajectory_class"), c("final_correct"), F.size("labels"), c("flips.ever_sycophantic_flip"), c("flips.recovered_after_flip"), c("reward.total"), weights)
    e = e.withColumn("trajectory_reward", total)
    return e.drop("parsed", "reward", *(x for x in e.columns if x.startswith("__")))


def generations(batch: DataFrame, role: str, example: str, order: str) -> DataFrame:
    """batch with generation: how many earlier rows of the same role and example there are."""
    return batch.withColumn("generation", F.row_number().over(Window.partitionBy(role, example).orderBy(order)) - 1)


def attach(batch: DataFrame, examples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """batch with its example's columns; a row without one raises, and so does an example that is there twice."""
    known = examples.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    j = batch.join(known, list(keys), "left")
    wrong = F.when(F.col("__n").isNull(), "a row names no example").when(F.col("__n") > 1, "an example is there twice")
    return j.where(F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).isNull())).drop("__n")


def evaluation_metric(metrics: Column) -> Column:
    """The reward among an evaluation's metrics (a map): one of three names, else the largest eval_ metric of a reward."""
    named = F.coalesce(*(F.try_element_at(metrics, F.lit(n)) for n in ("eval_reward", "eval_rewards/mean", "eval_reward/mean")))
    others = F.array_max(F.map_values(F.map_filter(metrics, lambda k, v: F.startswith(k, F.lit("eval_")) & F.contains(k, F.lit("reward")))))
    return F.coalesce(named, others)


def completion_text(completion: Column, kind: str) -> Column:
    """The text of a completion: itself, or of messages the content of the last that has one; else empty. kind: text,
    message (a struct) or messages (an array of these)."""
    if kind == "text":
        return F.coalesce(completion, F.lit(""))
    if kind == "message":
        return F.coalesce(completion["content"], F.lit(""))
    return F.coalesce(F.try_element_at(F.filter(completion, lambda m: m["content"].isNotNull()), F.lit(-1))["content"], F.lit(""))


def identified(prompts: DataFrame, prompt: str, id_key: str, role_key: str) -> DataFrame:
    """prompts with messages (role and content alone), data_role and example_id, which the last message of a prompt carries
    under reserved keys; and fault, null where all is there."""
    last = F.try_element_at(F.col(prompt), F.lit(-1))
    clean = F.transform(prompt, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    malformed = F.exists(prompt, lambda m: ~F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)) | m["content"].isNull())
    fault = (F.when(F.coalesce(F.size(prompt), F.lit(0)) <= 0, "a rollout needs a prompt of messages").when(F.coalesce(last[id_key], F.lit("")) == "", "the prompt has no identity")
             .when(~F.coalesce(last[role_key].isin("training", "validation"), F.lit(False)), "the prompt's role isn't one of development").when(F.coalesce(malformed, F.lit(False)), "a message is malformed"))
    return prompts.withColumns({"messages": clean, "data_role": last[role_key], "example_id": last[id_key], "fault": fault})
