"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import ann, brown, decontam, langid, linededup, mixing, secrets, sharding, simhash, toxicity
from sparkloom.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda f: lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))
    return {
        "op1_simhash": docs(simhash.op1_simhash),
        "op2_toxicity": lambda spark, sf_dir: toxicity.op2_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op3_secret_scan": docs(secrets.op3_secret_scan),
        "op4_line_dedup": docs(linededup.op4_line_dedup),
        "op5_sharding": docs(sharding.op5_sharding),
        "op6_class_lm": docs(brown.op6_class_lm),
        "op7_mixing": docs(mixing.op7_mixing),
        "op8_nearest": lambda spark, sf_dir: ann.op8_nearest(table(spark, sf_dir, "embeddings")),
        "op9_decontamination": lambda spark, sf_dir: decontam.op9_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op10_language_id": docs(langid.op10_language_id),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": linededup.ORACLE_SQL}
