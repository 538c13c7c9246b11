"""Stable identities, fingerprints and duplicate and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import casefold, squash, strip

NUL = "\u0000"


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(NUL, *parts), 256)


def stable_id(source: Column, prompt: Column, namespace: str) -> Column:
    """The source with - for /, and 16 digits of the digest of namespace, source and squashed, casefolded prompt."""
    return F.concat(F.replace(source, F.lit("/"), F.lit("-")), F.lit("-"), F.substring(_digest(F.lit(namespace), source, casefold(squash(prompt))), 1, 16))


def fingerprint(prompt: Column) -> Column:
    return F.sha2(casefold(squash(prompt)), 256)


def blinded_id(example_id: Column, model_id: Column, adapter_path: Column) -> Column:
    """An id that tells no model; a missing part is written None."""
    return F.substring(_digest(*(F.coalesce(c.cast("string"), F.lit("None")) for c in (example_id, model_id, adapter_path))), 1, 16)


def question_group(question_id: Column, prompt: Column) -> Column:
    return F.coalesce(F.nullif(question_id.cast("string"), F.lit("")), fingerprint(prompt))


def question_text(explicit: Column, prompt: Column) -> Column:
    """The stated question, else the prompt up to its first option; casefolded, squashed."""
    return squash(casefold(F.coalesce(F.when(strip(explicit) != "", explicit), F.split_part(prompt, F.lit("\n(A)"), F.lit(1)))))


def id_set_hash(df: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """count and sha256 of the sorted distinct ids, one a line. A group's ids meet in one row: for sets of the size of a
    split's manifest, not of a corpus."""
    ids = F.array_sort(F.collect_set(F.col(key).cast("string")))
    return df.groupBy(*by).agg(F.size(ids).cast("long").alias("ids"), F.sha2(F.array_join(ids, "\n"), 256).alias("ids_sha256"))


def duplicates(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """key, copies and first_id of the keys that several rows have; partial counts shrink hot keys before they move."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")


def overlap(df: DataFrame, key: str, role: str) -> DataFrame:
    """left, right and the number of keys in both roles, for all pairs of roles in one shuffle by key."""
    roles = df.groupBy(key).agg(F.array_sort(F.collect_set(role)).alias("roles")).where(F.size("roles") > 1)
    left = roles.select("roles", F.posexplode("roles").alias("i", "left"))
    return left.select("left", F.explode(F.slice("roles", F.col("i") + 2, F.size("roles"))).alias("right")).groupBy("left", "right").agg(F.count("*").alias("shared"))


def same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and side (left or right) of the keys that only one of two tables has; none if they are the same set."""
    both = left.select(key).distinct().withColumn("l", F.lit(True)).join(right.select(key).distinct().withColumn("r", F.lit(True)), key, "full_outer")
    return both.where("l is null or r is null").select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))
