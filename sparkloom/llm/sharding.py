"""Histogram sort: shards of near equal bytes by exact splitters of a key, found without sorting.

Key of a row: (63 bits of xxhash64(text), id, number). Equal texts are neighbours, so that a group of copies stays in one
shard unless a boundary falls into it; a group larger than a shard is cut by id. The number is 0 but for rows of a hot key
(equal in text and id, and cut by a boundary or more than a lane holds): these are told apart by their place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sparkloom.llm.common import durable, text_or_empty, tmp

H, D, SIZE, NUMBER, LANE, OFFSET, PART, ROW = (tmp(x) for x in ("h", "d", "size", "number", "lane", "offset", "part", "row"))
H_END = 2**63
HOT_KEYS = 1_000_000  # of three longs each: some 32 MB


@dataclass
class _Probe:
    """The range [lo, hi) in which a splitter lies; below: bytes of all keys under lo."""

    target: float
    lo: int
    hi: int
    below: int
    h: int | None = None  # the hash whose ids are searched
    number: int = 0  # of the rows of the key (h, lo) below the splitter
    cut: bool = False  # the splitter lies within the rows of one key
    done: bool = False


def _keyed(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Ids that aren't whole numbers count by their hash."""
    whole = isinstance(df.schema[id_col].dataType, IntegralType)
    return df.withColumns({
        H: F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 1),
        D: F.coalesce(F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col))), F.lit(-(2**63))),
        SIZE: F.octet_length(text_or_empty(F.col(text_col))).cast("long") + 1,
    })


def _case(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.when(*pairs[0])
    for cond, value in pairs[1:]:
        out = out.when(cond, value)
    return out


def _refine(slim: DataFrame, open_: list[_Probe], probes: int, tolerance: float) -> None:
    """One exact histogram of bytes over all open ranges; every splitter's range shrinks by the number of probes."""
    ranges = sorted({(p.h, p.lo, p.hi) for p in open_}, key=lambda r: (r[0] or 0, r[1]))
    step = {r: -(-(r[2] - r[1]) // probes) for r in ranges}
    exact = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  ids may span all of 64 bits
    wide = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    inside, cell = [], []
    for i, r in enumerate(ranges):
        h, lo, hi = r
        if h is None:
            cond = (F.col(H) >= F.lit(lo)) & (F.col(H) <= F.lit(hi - 1))
            sub = F.expr(f"({H} - {lo}L) div {step[r]}L")
        else:
            cond = (F.col(H) == F.lit(h)) & (exact(D) >= wide(lo)) & (exact(D) < wide(hi))
            sub = F.floor((exact(D) - wide(lo)) / wide(step[r])).cast("long")
        inside.append((cond, F.lit(i)))
        cell.append((cond, sub))
    counted = slim.select(_case(inside).alias("i"), _case(cell).alias("c"), F.col(SIZE)).where("i is not null")
    hist: dict[int, list[tuple[int, int]]] = {}
    for i, c, n in counted.groupBy("i", "c").agg(F.sum(SIZE)).collect():  # at most ranges x probes rows
        hist.setdefault(i, []).append((c, n))
    for p in open_:
        i = ranges.index((p.h, p.lo, p.hi))
        width, below = step[ranges[i]], p.below
        for c, n in sorted(hist.get(i, [])):
            at, left, right = p.lo + c * width, below, below + n
            if right < p.target - tolerance and right < p.target:
                below = right
                continue
            if abs(left - p.target) <= tolerance or abs(right - p.target) <= tolerance:
                near_left = abs(left - p.target) <= abs(right - p.target)
                p.lo, p.below, p.done = (at, left, True) if near_left else (at + width, right, True)
            elif width > 1:
                p.lo, p.hi, p.below = at, min(at + width, p.hi), left
            elif p.h is None:
                p.h, p.lo, p.below = at, None, left
            else:  # within the rows of one key
                p.lo, p.below, p.cut, p.done = at, left, True, True
            break
        else:
            p.lo, p.below, p.done = p.hi, below, True


def find_splitters(slim: DataFrame, shards: int, probes: int = 1024, tolerance: float = 0.001) -> list[tuple[int, int | None, int]]:
    """shards - 1 keys (hash, id or None for the first id, number); the bytes below each miss its target by at most
    tolerance x a shard's bytes, or by half a row where that is more. Numbers are those of _numbered."""
    total = slim.agg(F.sum(SIZE)).first()[0] or 0
    found = [_Probe(total * k / shards, 0, H_END, 0) for k in range(1, shards)]
    slack = tolerance * total / shards
    while open_ := [p for p in found if not p.done]:
        if fresh := [p for p in open_ if p.h is not None and p.lo is None]:
            ends = dict((r[0], r[1:]) for r in slim.where(F.col(H).isin([p.h for p in fresh])).groupBy(H).agg(F.min(D), F.max(D)).collect())
            for p in fresh:
                p.lo, p.hi = ends[p.h][0], ends[p.h][1] + 1
        _refine(slim, open_, probes, slack)
    if cut := [p for p in found if p.cut]:  # rows of equal texts are of equal size
        keys = {(r[0], r[1]): r[2] for r in slim.where(_among({(p.h, p.lo) for p in cut})).groupBy(H, D).agg(F.max(SIZE)).collect()}
        for p in cut:
            p.number = round((p.target - p.below) / keys[p.h, p.lo])
    return sorted(((p.lo, None, 0) if p.h is None else (p.h, p.lo, p.number) for p in found), key=lambda s: (s[0], -(2**64) if s[1] is None else s[1], s[2]))


def _among(keys: set[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for h, d in sorted(keys):
        out = out | ((F.col(H) == F.lit(h)) & (F.col(D) == F.lit(d)))
    return out


def _shard(splitters: list[tuple[int, int | None, int]]) -> Column:
    """The number of splitters at or below a row's key."""
    out = F.lit(0)
    for h, d, number in splitters:
        if h >= H_END:
            continue
        if d is None:
            over = F.col(H) >= F.lit(h)
        elif d >= H_END:  # past the last id of this hash
            over = F.col(H) > F.lit(h)
        else:
            over = (F.col(H) > F.lit(h)) | ((F.col(H) == F.lit(h)) & ((F.col(D) > F.lit(d)) | ((F.col(D) == F.lit(d)) & (F.col(NUMBER) >= F.lit(number)))))
        out = out + over.cast("int")
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with NUMBER: their places among the rows of their key, from 0. A task numbers its own part of the written
    rows, and a part's first number comes from exact counts, so that no task holds a whole key."""
    rows = durable(rows).withColumns({PART: F.spark_partition_id(), ROW: F.monotonically_increasing_id()})
    here = Window.partitionBy(H, D, PART)
    counts = rows.groupBy(H, D, PART).agg(F.count("*").alias("n"))
    before = Window.partitionBy(H, D).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(H, D, PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(OFFSET))
    placed = rows.withColumn(NUMBER, F.row_number().over(here.orderBy(ROW)).cast("long") - 1)
    return placed.join(first, [H, D, PART]).withColumn(NUMBER, F.col(NUMBER) + F.col(OFFSET)).drop(PART, OFFSET, ROW)


def histogram_sort_shards(df: DataFrame, shards: int = 16, text_col: str = "text", id_col: str = "doc_id",
                          probes: int = 1024, tolerance: float = 0.001, lane_rows: int = 65_536, lane_bytes: int = 128 << 20) -> DataFrame:
    """df's rows with shard (0 to shards - 1) and slot (gapless from 0 in its shard), native plan only.

    The bytes (UTF-8 of the text, plus 1) of all shards are near equal. A slim copy (hash, id, size) is written once;
    the histogram rounds read only that. Texts move in one exchange, by (shard, lane): a lane is a hashed part of a
    shard of about lane_rows rows or lane_bytes bytes, so that no task numbers a whole shard; a lane's first slot comes
    from exact counts. Only the rows of hot keys are written before, to be numbered.

    Null text: no bytes, size 1. Null id: ordered first. Ids of any type. Repeated rows are divided like any others, and
    are interchangeable. Empty table: empty result. Columns of df named shard or slot are replaced.
    """
    keyed = _keyed(df.drop("shard", "slot"), text_col, id_col)
    slim = durable(keyed.select(H, D, SIZE))
    splitters = find_splitters(slim, shards, probes, tolerance)
    rows, size = slim.agg(F.count("*"), F.coalesce(F.sum(SIZE), F.lit(0))).first()
    lanes = max(1, -(-rows // (shards * lane_rows)), -(-size // (shards * lane_bytes)))
    cut = {(h, d) for h, d, number in splitters if number}
    hot = durable(slim.groupBy(H, D).agg(F.count("*").alias("n")).where((F.col("n") > lane_rows) | _among(cut)).select(H, D))
    few = hot.count()
    if few:
        hot = F.broadcast(hot) if few <= HOT_KEYS else hot
        numbered = _numbered(keyed.join(hot, [H, D], "left_semi"))
        keyed = keyed.join(hot, [H, D], "left_anti").withColumn(NUMBER, F.lit(0).cast("long")).unionByName(numbered)
        slim = slim.join(hot, [H, D], "left_anti").withColumn(NUMBER, F.lit(0).cast("long")).unionByName(numbered.select(H, D, SIZE, NUMBER))
    else:
        keyed, slim = (x.withColumn(NUMBER, F.lit(0).cast("long")) for x in (keyed, slim))
    place = {"shard": _shard(splitters), LANE: F.pmod(F.xxhash64(H, D, NUMBER), F.lit(lanes))}
    counts = slim.select(place["shard"].alias("shard"), place[LANE].alias(LANE)).groupBy("shard", LANE).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(LANE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", LANE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(OFFSET))
    ordered = Window.partitionBy("shard", LANE).orderBy(H, D, NUMBER)
    placed = keyed.withColumns(place).withColumn("slot", F.row_number().over(ordered).cast("long") - 1)
    slotted = placed.join(offsets, ["shard", LANE]).withColumn("slot", F.col("slot") + F.col(OFFSET))
    return slotted.select(*[c for c in df.columns if c not in ("shard", "slot")], "shard", "slot")


def op5_sharding(documents: DataFrame) -> DataFrame:
    """The contract's digest of histogram_sort_shards over all documents, law bytes; null and repeated ids and texts,
    empty tables and other columns as there."""
    digest = documents.select(
        "doc_id", "text",
        (F.octet_length(text_or_empty(F.col("text"))).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty(F.col("text")).cast("binary")).alias("text_crc32"),
    )
    return histogram_sort_shards(digest).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))
