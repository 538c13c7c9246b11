"""Subset-sum budget fitting: sources mixed to target word counts, exactly where the lengths allow it."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, durable, text_or_empty, tmp

SRC, NOSRC, SIZE, SEED, LANE, LANES, OFFSET, RANK = (tmp(x) for x in ("src", "nosrc", "size", "seed", "lane", "lanes", "offset", "rank"))
LANE_ROWS = 65_536
HOT_BYTES = 64 << 20  # of the table of hot lengths, to be broadcast
WINDOW = 1 << 18  # sums of words that the knapsack looks at
MOST = 3  # copies of a document, and its source's words, at most


def water_fill(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Targets in proportion to the weights that add up to all sizes, none above most x its size."""
    left, open_, targets = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / weight for i in open_}
        full = {i for i in open_ if share[i] > most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = share[i]
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ -= full
    return targets


def _reach(spare: dict[int, int], low: int, high: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Bounded knapsack over all sums up to high: for each the step by which it was first reached (-1: not at all, 0: the
    empty sum), and the steps: a length and how many documents of it. Binary parts of a length's number are a step each;
    the sweep ends as soon as low is reached."""
    first = np.full(high + 1, -1, np.int32)
    first[0] = 0
    reached = first >= 0
    steps = [(0, 0)]
    for n in sorted(spare, reverse=True):
        left, part = min(spare[n], high // n), 1
        while left > 0 and not reached[low]:
            part = min(part, left)
            steps.append((n, part))
            fresh = reached[:high + 1 - n * part] & ~reached[n * part:]
            first[n * part:][fresh] = len(steps) - 1
            reached[n * part:] |= fresh
            left -= part
            part *= 2
    return first, steps


def _nearest_sum(spare: dict[int, int], rest: float) -> dict[int, int]:
    """How many of each length come nearest to rest in sum (ties: the lower sum), none more often than spare."""
    if rest <= 0 or not spare:
        return {}
    low, high = int(rest), math.ceil(rest) + max(spare)
    first, steps = _reach(spare, round(rest), high)
    sums = np.flatnonzero(first >= 0)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    take: dict[int, int] = {}
    while at:
        n, part = steps[first[at]]
        take[n] = take.get(n, 0) + part
        at -= n * part
    return take


def fit_budget(counts: dict[int, int], target: float, most: int = MOST, window: int = WINDOW) -> tuple[int, dict[int, int]]:
    """(copies of every document, further copies dealt to the documents of each length) for the words near the target.

    Whole copies and then each length's even share of what remains come first, but for about window / 2 words (all, if
    these are fewer), which the knapsack chooses. Where that doesn't meet the target, the knapsack chooses among 0 to most
    copies of each document, again but for even shares beyond the window. So a target of at most window / 2 words is met by
    the nearest sum that any choice has."""
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if not total:
        return 0, {}
    copies = min(most, int(target // total))
    best: tuple[float, int, dict[int, int]] = (abs(target - copies * total), copies, {})
    for whole, upto in dict.fromkeys(((copies, min(copies + 1, most)), (copies, most), (0, most))):
        budget = target - whole * total
        if best[0] < 1 or budget <= 0:
            break
        even = max(0.0, budget - window / 2) / budget
        take = {n: min(c * (upto - whole), int(c * budget / total * even)) for n, c in counts.items()}
        more = _nearest_sum({n: c * (upto - whole) - take[n] for n, c in counts.items()}, budget - sum(n * x for n, x in take.items()))
        for n, x in more.items():
            take[n] += x
        off = abs(budget - sum(n * x for n, x in take.items()))
        if off < best[0] - 1e-9:
            best = off, whole, {n: x for n, x in take.items() if x}
    return best[1:]


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    copies, more = fit_budget(dict(zip(pdf[SIZE].tolist(), pdf["n"].tolist(), strict=True)), float(pdf["target"].iloc[0]))
    out = pdf[[SRC, NOSRC, SIZE, "n", "source_size", "target"]].copy()
    out["copies"] = copies
    out["more"] = [more.get(n, 0) for n in pdf[SIZE].tolist()]
    return out


def mix(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
        weights: Sequence[float] = (1, 2, 3), seed: int = 7, lane_rows: int | None = None) -> DataFrame:
    """df's rows with size, source_size, target and taken: the words that the mix takes of the row.

    Words are counted once into (source, exact length) histograms. A source's histogram, bounded by its distinct
    lengths, is fitted by fit_budget in one task. Which documents of a length get one more copy is by seeded hash:
    ranks come from lanes (ranges of the hash in a length's documents) and exact lane counts, so that no task ranks a whole
    hot length. A lane has about lane_rows rows: unless it is stated, a quarter of a shuffle partition's share of all rows, at
    most LANE_ROWS; the result is the same for any. The driver holds one row per source.

    Null text: size 0. Null source: a source of its own, last. Documents of no words: taken 0. Rows equal in id and
    text are interchangeable. Empty table: empty result. Columns of df with the result's names are replaced.
    """
    spark = df.sparkSession
    names = ("size", "source_size", "target", "taken")
    own = [c for c in df.columns if c not in names]
    text = text_or_empty(F.col(text_col))
    sized = df.select(
        *own,
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias(SRC), F.col(source_col).isNull().alias(NOSRC),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias(SIZE),
        F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text)).alias(SEED))
    slim = durable(sized.select(SRC, NOSRC, SIZE, SEED))
    hist = durable(slim.groupBy(SRC, NOSRC, SIZE).agg(F.count("*").alias("n")))
    sums = hist.groupBy(SRC, NOSRC).agg(F.sum(F.col(SIZE) * F.col("n")).alias("s")).collect()
    sums.sort(key=lambda r: (r[1], r[0]))
    targets = water_fill([r[2] for r in sums], [weights[i % len(weights)] for i in range(len(sums))])
    by_source = spark.createDataFrame(
        [(r[0], r[1], r[2], t) for r, t in zip(sums, targets, strict=True)], f"{SRC} string, {NOSRC} boolean, source_size long, target double")
    plan = durable(hist.join(by_source, [SRC, NOSRC]).groupBy(SRC, NOSRC).applyInPandas(
        _fit, f"{SRC} string, {NOSRC} boolean, {SIZE} long, n long, source_size long, target double, copies int, more long"))
    key = [SRC, NOSRC, SIZE]
    if lane_rows is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        lane_rows = min(LANE_ROWS, 1 + (hist.agg(F.sum("n")).first()[0] or 0) // (4 * parts))
    hot = hist.where(F.col("n") > lane_rows).select(*key, F.ceil(F.col("n") / lane_rows).alias(LANES))  # a row for each lane_rows rows at most
    hot = F.broadcast(hot) if (hot.agg(F.sum(F.octet_length(SRC) + 64)).first()[0] or 0) <= HOT_BYTES else hot
    lane = lambda n: F.least(n - 1, F.floor((F.col(SEED).cast("double") / F.lit(2.0**64) + 0.5) * n))  # noqa: E731  in the order of SEED
    laned = lambda df: df.join(hot, key, "left").withColumn(LANE, lane(F.coalesce(LANES, F.lit(1)))).drop(LANES)
    before = Window.partitionBy(*key).orderBy(LANE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = laned(slim).groupBy(*key, LANE).agg(F.count("*").alias("n")).select(
        *key, LANE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(OFFSET))
    ranked = laned(sized).withColumn(RANK, F.row_number().over(Window.partitionBy(*key, LANE).orderBy(SEED)))
    joined = ranked.join(offsets.join(plan, key), [*key, LANE])
    # further copies go round the documents of a length in the order of their ranks
    copies = F.col("copies") + F.expr("cast(more div n as int)") + (F.col(RANK) + F.col(OFFSET) <= F.col("more") % F.col("n")).cast("int")
    return joined.select(*own, F.col(SIZE).alias("size"), "source_size", "target", (F.col(SIZE) * copies).alias("taken"))


def repeat_taken(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as its words were taken."""
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.withColumn(tmp("copy"), F.explode(F.array_repeat(F.lit(0), copies))).drop(tmp("copy"), "size", "source_size", "target", "taken")


def op7_mixing(documents: DataFrame) -> DataFrame:
    """The contract's digest of mix over all documents."""
    return mix(documents.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
