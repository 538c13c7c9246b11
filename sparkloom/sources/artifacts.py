"""What a prepared dataset leaves on disk and the checks on it: splits with manifests, logs, cached scans, guards."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.identity import id_set_hash, same_ids
from sparkloom.sources.canonical import pool_kind
from sparkloom.sources.records import file_digest, write_json

#: The settings that two runs' generations must share.
SETTINGS = ("do_sample", "temperature", "top_p", "top_k", "repetition_penalty")


def canonical_json(value: Column, kind: str) -> Column:
    """A struct's JSON with sorted keys and ", " and ": " between, as digests of prompts need it; kind: the fields' names in
    any order, comma-separated, all text."""
    names = sorted(kind.split(","))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"\A\[|\]\z", "")
    parts = [F.concat(F.lit(f'"{n}": '), F.coalesce(quoted(value[n]), F.lit("null"))) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def prompt_digest(messages: Column) -> Column:
    """sha256 of a prompt's messages as sorted JSON."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(messages, lambda m: canonical_json(m, "role,content")), ", "), F.lit("]")), 256)


def write_splits(rows: DataFrame, path: str, role: str = "split", key: str = "example_id", seed: int = 42, source: str | None = None) -> dict:
    """rows by role as sorted JSON lines, a list of ids for each role, and a manifest of counts and digests of ids; an
    existing folder is refused. The lists pass through the driver a part at a time."""
    if Path(path).exists():
        raise FileExistsError(path)
    rows.repartition(role).sortWithinPartitions(role, key).write.partitionBy(role).mode("error").json(f"{path}/rows")
    found = {r[role]: {"count": r["ids"], "ids_sha256": r["ids_sha256"]} for r in id_set_hash(rows, key, (role,)).collect()}
    manifest = {"schema_version": 1, "seed": seed, "source_sha256": file_digest(source) if source else None, "splits": found}
    for name in found:
        ids = rows.where(F.col(role) == name).select(F.col(key).cast("string").alias("id")).orderBy("id").toLocalIterator()
        with open(f"{path}/{name}_ids.json", "w", encoding="utf-8") as out:
            out.write("[")
            for i, row in enumerate(ids):
                out.write(("," if i else "") + "\n  " + json.dumps(row.id, ensure_ascii=False))
            out.write("\n]\n")
    write_json(f"{path}/manifest.json", manifest)
    return manifest


def check_splits(spark: SparkSession, path: str, role: str = "split", key: str = "example_id", pool: DataFrame | None = None) -> None:
    """Raises where the rows on disk differ from the manifest's counts and ids, or from the pool's."""
    manifest = json.loads(Path(path, "manifest.json").read_text(encoding="utf-8"))
    rows = spark.read.json(f"{path}/rows")
    found = {r[role]: {"count": r["ids"], "ids_sha256": r["ids_sha256"]} for r in id_set_hash(rows, key, (role,)).collect()}
    if found != manifest["splits"]:
        raise ValueError("the splits differ from their manifest")
    if pool is not None and not same_ids(rows, pool, key).isEmpty():
        raise ValueError("the splits and the pool hold different ids")


def load_ids(path: str) -> list[str]:
    """A JSON list of texts; anything else raises."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, list) or any(not isinstance(x, str) for x in value):
        raise ValueError(f"{path} must hold a list of example ids")
    return value


def same_order(rows: DataFrame, key: str, ordinal: str, ids: list[str]) -> bool:
    """Whether the rows' keys, by their ordinal from 0, are the listed ids."""
    listed = rows.sparkSession.createDataFrame(list(enumerate(ids)), "i long, id string")
    both = rows.select(F.col(ordinal).cast("long").alias("i"), F.col(key).cast("string").alias("k")).join(listed, "i", "full_outer")
    return both.where(~F.col("k").eqNullSafe(F.col("id"))).isEmpty()


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines."""
    df.write.mode("append").json(path)


class CachedScan:
    """A file's rows, read again only when its time or size changes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seen, self.rows = spark, path, None, None

    def get(self) -> DataFrame:
        stat = os.stat(self.path)
        if (sign := (stat.st_mtime_ns, stat.st_size)) != self.seen:
            if self.rows is not None:
                self.rows.unpersist()
            self.rows, self.seen = self.spark.read.json(self.path).persist(), sign
        return self.rows


def require_real_pool(rows: DataFrame) -> None:
    """Raises unless the pool has rows and no fixture is among them."""
    kind = pool_kind(rows).first().kind
    if kind != "real_only":
        raise ValueError(f"the training pool is {kind}")


def benchmark_path(path: str) -> str:
    """path, unless it lies below a folder of training data or splits."""
    if {"training", "splits"} & {p.lower() for p in Path(path).parts[:-1]}:
        raise ValueError("benchmark output must not be written below training or split data")
    return path


def same_settings(a: Column, b: Column) -> Column:
    """Whether two settings structs agree on what shapes a generation; null equals null."""
    out = F.lit(True)
    for name in SETTINGS:
        out = out & a[name].eqNullSafe(b[name])
    return out


def contamination(rows: DataFrame, role: str = "data_role", flag: str = "benchmark_only") -> DataFrame:
    """The rows that may not be trained on: of the benchmark by role or flag."""
    return rows.where((F.col(role) == "benchmark") | F.coalesce(F.col(flag), F.lit(False)))
