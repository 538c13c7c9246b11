"""Keyed sessions: steps in, rewards and grades out; as a stream with state and as the batch fold that must agree."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

STEP = "session long, step long, reward double, ts timestamp"
STATE = "steps long, total double, low double, last timestamp"
GRADE = "session long, steps long, total_reward double, mean_reward double, passed boolean"


def grade(steps: DataFrame, session: str = "session", reward: str = "reward", order: str = "step") -> DataFrame:
    """session, steps, total, mean, passed (every step above 0) and the rewards in order."""
    scores = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(reward).alias("r")))), lambda x: x["r"])
    got = steps.groupBy(session).agg(F.count("*").alias("steps"), F.sum(reward).alias("total_reward"), F.avg(reward).alias("mean_reward"), F.bool_and(F.col(reward) > 0).alias("passed"), scores.alias("component_scores"))
    return got


def expire(steps: DataFrame, session: str, ts: str, ttl_seconds: float, order: str) -> DataFrame:
    """steps with life: how often the session had been left for longer than ttl_seconds before; 0 seconds never end it."""
    w = Window.partitionBy(session).orderBy(ts, order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    late = F.coalesce(gap > F.lit(int(ttl_seconds * 1_000_000)), F.lit(False)) & F.lit(ttl_seconds > 0)
    return steps.withColumn("__late", late.cast("int")).withColumn("life", F.sum("__late").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__late")


def admit(sessions: DataFrame, started: str, ended: str, order: str, cap: int = 64) -> DataFrame:
    """sessions with open (how many admitted ones are live as each starts) and admitted (fewer than the cap). A session that
    wasn't admitted is never open. Starts count in the order of started and then order; one that ends as another starts is
    over; null ends never come. Sessions without a start are refused, with no open.

    What one start may do depends on all before it, so the fold is in order; it holds at most cap ends. Runs between which
    no session is live, whoever is admitted, don't depend on each other and are folded apart: their bounds come from the
    latest end before each start, by hours and then within hours."""
    far = F.lit("9999-12-31").cast("timestamp")
    rows = sessions.withColumns({"__s": F.col(started).cast("timestamp"), "__e": F.coalesce(F.col(ended).cast("timestamp"), far)}).withColumn("__hour", F.date_trunc("hour", "__s"))
    timed = rows.where(F.col("__s").isNotNull())
    earlier = Window.orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = timed.groupBy("__hour").agg(F.max("__e").alias("__last")).select("__hour", F.max("__last").over(earlier).alias("__before"))  # a row an hour
    here = Window.partitionBy("__hour").orderBy("__s", order)
    latest = F.greatest("__before", F.max("__e").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = timed.join(hours, "__hour", "left").withColumn("__latest", latest).withColumn("__new", (F.col("__latest").isNull() | (F.col("__latest") <= F.col("__s"))).cast("int"))
    news = fresh.groupBy("__hour").agg(F.sum("__new").alias("__n")).select("__hour", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__runs"))
    run = F.col("__runs") + F.sum("__new").over(here.rowsBetween(Window.unboundedPreceding, 0))
    dealt = fresh.join(news, "__hour", "left").withColumn("__run", run).select(*sessions.columns, "__run", "__s", "__e").repartition("__run").sortWithinPartitions("__run", "__s", order)
    names, kept = sessions.columns, len(sessions.columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends = None, []
        for batch in batches:
            counts, told = [], []
            for run_, start, end in zip(*(batch.column(kept + i).cast(pa.int64()).to_pylist() for i in range(3)), strict=True):
                if run_ != at:
                    at, ends = run_, []
                while ends and ends[0] <= start:
                    heapq.heappop(ends)
                counts.append(len(ends))
                told.append(len(ends) < cap)
                if told[-1]:
                    heapq.heappush(ends, end)
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(counts, pa.int64()), pa.array(told, pa.bool_())], names=[*names, "open", "admitted"])

    schema = StructType([*sessions.schema.fields, StructField("open", LongType()), StructField("admitted", BooleanType())])
    without = rows.where(F.col("__s").isNull()).select(*sessions.columns, F.lit(None).cast("long").alias("open"), F.lit(False).alias("admitted"))
    return dealt.mapInArrow(fold, schema).unionByName(without)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds a micro-batch's steps to a session and sends its grade so far; a session left for the time to live ends."""
    if state.hasTimedOut:
        state.remove()
        return
    steps, total, low, last = state.get if state.exists else (0, 0.0, float("inf"), None)
    for pdf in batches:
        steps += len(pdf)
        total += float(pdf["reward"].sum())
        low = min(low, float(pdf["reward"].min()))
        newest = pdf["ts"].max().to_pydatetime()
        last = newest if last is None else max(last, newest)
    state.update((steps, total, low, last))
    yield pd.DataFrame({"session": [key[0]], "steps": [steps], "total_reward": [total], "mean_reward": [total / steps if steps else 0.0], "passed": [steps > 0 and low > 0]})


def _fold_until(ttl_ms: int):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _fold(key, batches, state)
        if state.exists and ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    return fold


def stream_grades(steps: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """The running grade of each session of a stream of STEP rows, one row a session and micro-batch (update mode)."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_seconds else GroupStateTimeout.NoTimeout
    return steps.groupBy("session").applyInPandasWithState(_fold_until(ttl_seconds * 1000), GRADE, STATE, "update", timeout)


def session_windows(events: DataFrame, key: str, ts: str, gap: str, watermark: str) -> DataFrame:
    """Sessions of a stream by event time: key, start, end and events; late rows beyond the watermark go."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    return timed.groupBy(key, F.session_window("__ts", gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def violations(requests: DataFrame, response: str = "response", finish_reason: str = "finish_reason", longest: int = 16_000) -> DataFrame:
    """requests with fault: a response of 1 to longest characters once stripped, an end of eos, length or none."""
    from sparkloom.functions.text import strip

    n = F.length(strip(F.col(response)))
    fault = (F.when(F.coalesce(n, F.lit(0)) < 1, "response is empty").when(n > longest, "response is too long")
             .when(F.col(finish_reason).isNotNull() & ~F.col(finish_reason).isin("eos", "length"), "finish_reason is unknown"))
    return requests.withColumn("fault", fault)
