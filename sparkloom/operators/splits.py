"""Group-aware deterministic splits, samples, shards and their audits. The order of a draw is a hash of seed and key, so
it depends on no partitioning; mode="compatible" draws with Python's seeded generator, on the driver, for small tables."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.identity import id_set_hash, overlap


def draw_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_rank(df: DataFrame, key: str, seed: int, name: str = "rank") -> DataFrame:
    """df with the rank (from 1) of its rows by the hash of seed and key, and then key.

    The hash's first digits are cells; exact counts of cells give each its first rank, so that no task orders all rows."""
    keyed = df.withColumn("__h", draw_key(F.col(key), seed)).withColumn("__cell", F.substring("__h", 1, 3))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = keyed.groupBy("__cell").agg(F.count("*").alias("__n")).select("__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # 4096 rows at most
    inner = Window.partitionBy("__cell").orderBy("__h", key)
    return keyed.withColumn("__r", F.row_number().over(inner)).join(F.broadcast(cells), "__cell").withColumn(name, (F.col("__r") + F.col("__before")).cast("long")).drop("__h", "__cell", "__r", "__before")


def allocate_groups(rows: DataFrame, group: str, seed: int = 42, validation_fraction: float = 0.15, test_fraction: float = 0.15, mode: str = "hash") -> DataFrame:
    """group and split: the first groups of the drawn order are the test, the next the validation, the rest the training
    set. Sizes round half to even, one at least; if nothing were left to train on, both are one."""
    if validation_fraction <= 0 or test_fraction <= 0 or validation_fraction + test_fraction >= 1:
        raise ValueError("fractions must be positive and leave something to train on")
    groups = rows.select(F.col(group).cast("string").alias("group")).distinct()
    n = groups.count()
    if n < 3:
        raise ValueError("at least three distinct groups are required")
    n_validation, n_test = max(1, round(n * validation_fraction)), max(1, round(n * test_fraction))
    if n_validation + n_test >= n:
        n_validation = n_test = 1
    if mode == "compatible":
        names = sorted(r[0] for r in groups.collect())
        random.Random(seed).shuffle(names)
        ranked = rows.sparkSession.createDataFrame([(g, i + 1) for i, g in enumerate(names)], "group string, rank long")
    else:
        ranked = hash_rank(groups, "group", seed)
    return ranked.select("group", F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_validation, "validation").otherwise("training").alias("split"))


def split_rows(rows: DataFrame, group: str, **options) -> DataFrame:
    """rows with their group's split."""
    parts = allocate_groups(rows, group, **options)
    return rows.withColumn("__g", F.col(group).cast("string")).join(parts, F.col("__g") == parts["group"]).drop("__g", parts["group"])


def split_counts(rows: DataFrame, key: str, counts: dict[str, int], seed: int = 42, mode: str = "hash") -> DataFrame:
    """rows with role: exactly counts rows of each, in the drawn order; another number of rows raises."""
    total, n = sum(counts.values()), rows.count()
    if n != total:
        raise ValueError(f"expected exactly {total} rows, found {n}")
    if mode == "compatible":
        ids = sorted(r[0] for r in rows.select(F.col(key).cast("string")).collect())
        random.Random(seed).shuffle(ids)
        order = rows.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(ids)], "__k string, rank long")
        ranked = rows.join(order, F.col(key).cast("string") == F.col("__k")).drop("__k")
    else:
        ranked = hash_rank(rows, key, seed)
    role, upto = None, 0
    for name, size in counts.items():
        upto += size
        role = F.when(F.col("rank") <= upto, name) if role is None else role.when(F.col("rank") <= upto, name)
    return ranked.withColumn("role", role).drop("rank")


def sample(rows: DataFrame, key: str, count: int, seed: int = 42) -> DataFrame:
    """count rows, the first of the drawn order; fewer raise."""
    if count < 1:
        raise ValueError("the sample must have a row")
    got = rows.withColumn("__h", draw_key(F.col(key), seed)).orderBy("__h", key).limit(count).drop("__h")
    if got.count() < count:
        raise ValueError(f"fewer than {count} rows to sample")
    return got


def reservoir(rows, count: int, seed: int = 42) -> list:
    """Algorithm R over an iterator (toLocalIterator of a table in order), with Python's generator: for compatibility."""
    if count < 3:
        raise ValueError("sample count must be at least 3")
    rng, kept, seen = random.Random(seed), [], 0
    for row in rows:
        seen += 1
        if len(kept) < count:
            kept.append(row)
        elif (at := rng.randrange(seen)) < count:
            kept[at] = row
    if len(kept) < count:
        raise ValueError(f"only {len(kept)} rows, {count} asked for")
    return kept


def limit_then_shard(rows: DataFrame, order: list[str], most: int | None, shards: int, shard: int) -> DataFrame:
    """The rows at places 0 to most - 1 of the order that are shard modulo shards, with place.

    The first rows of an order are few, and numbered in one place. Without most, places come from one range exchange and
    counts of its partitions, not from a window over all rows; the partitions' number is stated, so that both readings of
    the exchange have the same."""
    if not 0 <= shard < shards:
        raise ValueError("shard must be from 0 to shards - 1")
    if most is not None:
        first = rows.orderBy(*order).limit(most)
        return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long") - 1).where(F.pmod("place", F.lit(shards)) == shard)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tagged = ordered.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftrightunsigned("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND(F.lit(2**33 - 1)))
    starts = tagged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))  # a row a partition
    placed = tagged.join(F.broadcast(starts), "__p").withColumn("place", F.col("__s") + F.col("__i")).drop("__m", "__p", "__i", "__s")
    return placed.where(F.pmod("place", F.lit(shards)) == shard)


def audit(rows: DataFrame, key: str, role: str, expected: tuple[str, ...]) -> DataFrame:
    """role, rows, ids and ids_sha256 for the expected roles; duplicate ids, shared ids and other roles raise."""
    per = rows.groupBy(role).agg(F.count("*").alias("rows")).join(id_set_hash(rows, key, (role,)), role)
    shared = overlap(rows, key, role).agg(F.sum("shared").alias("shared"))
    names = rows.agg(F.array_sort(F.collect_set(role)).alias("names"))
    checked = per.crossJoin(F.broadcast(shared)).crossJoin(F.broadcast(names))
    wrong = (F.when(F.col("rows") != F.col("ids"), F.concat(F.lit("duplicate ids in "), F.col(role))).when(F.col("shared") > 0, "ids are in two roles")
             .when(F.col("names") != F.array(*(F.lit(x) for x in sorted(expected))), "roles are not those expected"))
    return checked.where(F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).isNull())).select(role, "rows", "ids", "ids_sha256")


def govern(rows: DataFrame, role: str, opt_in: str = "opted_in") -> DataFrame:
    """rows with the flags that their role asks for: benchmark rows are benchmark only and never opted in."""
    held = F.col(role) == "benchmark"
    return rows.withColumns({"benchmark_only": held, opt_in: F.col(role).isin("training", "validation")})
