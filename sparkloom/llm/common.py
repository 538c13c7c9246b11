"""What the operators of this subpackage share: durable tables, text tokens and small column helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.tables import durable, shared_dir

__all__ = ["WORD", "crc32_mod", "durable", "rows_of", "shared_dir", "table", "text_or_empty", "tmp", "words_of"]

#: A token is a run of anything but space and the five ASCII controls TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tmp(name: str) -> str:
    """A column name that no input has."""
    return f"__sl_{name}"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def crc32_mod(id_col: str, n: int) -> Column:
    """crc32 of an id's text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) tokens; bytes.split() splits at exactly the characters that WORD excludes."""
    return text.lower().split()


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most that many, so that what is made per slice stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
