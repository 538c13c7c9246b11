"""Every query with SQL beside it must give the SQL's rows; the others must give rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NA or (np.isscalar(x) and pd.isna(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.number)):
        return round(float(x), 7) + 0.0
    return str(x)


def rows(df):
    names = sorted(df)
    return names, sorted((tuple(plain(v) for v in r) for r in df[names].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).df())
    assert len(got)


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    names = ("multi_turn", "group_split", "shard_modulo", "choice_baselines", "bootstrap", "hash_sample")
    first = {n: rows(QUERIES[n](spark, SF).toPandas()) for n in names}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert {n: rows(QUERIES[n](spark, SF).toPandas()) for n in names} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
