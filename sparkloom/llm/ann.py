"""Approximate nearest neighbours: an inverted file of coarse cells, residuals in product-quantised codes, asymmetric
distance tables, exact reranking.

The centroids, codebooks and the number of cells to probe are fitted on a bounded sample; every row is indexed. Cells grow
with the square root of the rows, in two levels: a row looks for its cell below the nearest few of the coarse centroids. The
sample stands for the table: of a sample that holds a share of the rows, that share of the k neighbours is looked for when
the cells to probe are counted. Cells are packed into shards of bounded rows, and a cell that is larger is split over
several, so that a vector which a third of the rows share burdens no task. A query goes to the shards of its probed cells,
in blocks of bounded queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import durable, rows_of

SAMPLE = 20_000  # rows to fit on, or PER_CELL for each cell if that is more
PER_CELL = 16
MOST_CELLS = 65_536  # so at most 1,048,576 rows to fit on
FLAT = 256  # cells of one level
BEAM = 3  # coarse cells below which a row looks for its cell
PARTS = 16
CODES = 256
SHARD_ROWS = 16_384
QUERY_BLOCK = 8_192
MOST_SHARDS = 1_000_000  # whose numbers are broadcast: 16 MB
RECALL = 0.97  # of the sample's true neighbours that must lie in probed cells
DEPTH = 40  # candidates reranked for each neighbour asked for, in each shard


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        counts = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if (~full).any():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    out = np.empty(len(x), np.int32)
    for at in range(0, len(x), 8192):
        out[at:at + 8192] = np.argmax(x[at:at + 8192] @ centres.T - half, axis=1)
    return out


@dataclass
class Index:
    """Cells' centroids by coarse cell, the residuals' codebooks (parts x codes x width / parts), cells to probe."""

    coarse: np.ndarray
    bounds: np.ndarray  # coarse cell c has the centroids bounds[c] to bounds[c + 1] - 1
    centres: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.books)

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, self.parts, axis=1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid below the BEAM nearest coarse ones."""
        beam, half = min(BEAM, len(self.coarse)), (self.centres**2).sum(1) / 2
        near = np.argpartition((self.coarse**2).sum(1) / 2 - x @ self.coarse.T, beam - 1, axis=1)[:, :beam] if beam < len(self.coarse) else np.tile(np.arange(beam), (len(x), 1))
        best, at = np.full(len(x), -np.inf, np.float32), np.zeros(len(x), np.int32)
        for c in np.unique(near).tolist():
            rows = np.flatnonzero((near == c).any(1))
            lo, hi = self.bounds[c], self.bounds[c + 1]
            if hi > lo:
                score = x[rows] @ self.centres[lo:hi].T - half[lo:hi]
                top = score.argmax(1)
                value = score[np.arange(len(rows)), top]
                better = value > best[rows]
                best[rows[better]], at[rows[better]] = value[better], lo + top[better]
        return at

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = self.cells(x)
        rest = self.cut(x - self.centres[cells])
        return cells, np.stack([_nearest(r, b) for r, b in zip(rest, self.books, strict=True)], axis=1).astype(np.uint8)

    def probed(self, q: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """Cells by query, the nearest first: as many as were calibrated, and more until they hold least rows, if all do."""
        for at in range(0, len(q), 256):
            order = np.argsort(-(q[at:at + 256] @ self.centres.T), axis=1, kind="stable").astype(np.int32)
            enough = 1 + (np.cumsum(sizes[order], axis=1) < least).sum(1)
            yield from (cells[:max(self.probes, n)] for cells, n in zip(order, enough.tolist(), strict=True))


def cells_for(rows: int) -> int:
    """A power of two near the square root of the rows, with 16 rows a cell or more."""
    return int(max(1, min(rows // PER_CELL, MOST_CELLS, 2 ** round(np.log2(max(1.0, rows) ** 0.5)))))


def fit_index(x: np.ndarray, rows: int, k: int, seed: int = 5) -> Index:
    """x: the sample; rows: of the table to be indexed; k: neighbours asked for."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    cells = min(cells_for(rows), max(1, len(x) // PER_CELL))
    coarse = _kmeans(x, 1 if cells <= FLAT else 2 ** round(np.log2(cells) / 2), 8, rng)
    group = _nearest(x, coarse)
    members = np.bincount(group, minlength=len(coarse))
    below = [_kmeans(x[group == c], max(1, round(cells * n / len(x))), 8, rng) if n else coarse[c:c + 1] for c, n in enumerate(members.tolist())]
    centres = np.concatenate(below)
    index = Index(coarse, np.cumsum([0, *map(len, below)]), centres, np.empty(0), 1)
    at = index.cells(x)
    few = rng.choice(len(x), min(len(x), SAMPLE), replace=False)
    parts = min(PARTS, x.shape[1])
    index.books = [_kmeans(np.ascontiguousarray(r), CODES, 6, rng) for r in np.array_split(x[few] - centres[at[few]], parts, axis=1)]
    k = min(max(1, round(k * len(x) / max(1, rows))), len(x) - 1)
    found = []
    for asked in np.array_split(rng.choice(len(x), min(1_024, len(x)), replace=False), 16) if k else []:
        near = x[asked] @ x.T
        near[np.arange(len(asked)), asked] = -np.inf
        true = np.argpartition(-near, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(x[asked] @ centres.T), axis=1, kind="stable"), axis=1)
        found.append(np.take_along_axis(place, at[true], axis=1).ravel())
    if found:
        index.probes = min(len(centres), 1 + int(np.quantile(np.concatenate(found), RECALL, method="higher")))
    return index


@dataclass
class Shards:
    """Cell c's rows are in the shards first[c] to first[c] + spread[c] - 1, by a row's hash."""

    first: np.ndarray
    spread: np.ndarray
    count: int

    @staticmethod
    def pack(sizes: np.ndarray, most: int) -> Shards:
        first, spread, shard, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, most
        for c, n in enumerate(sizes.tolist()):
            if n > most:
                shard += room < most
                spread[c], first[c] = -(-n // most), shard
                shard, room = shard + int(spread[c]), most
                continue
            if n > room:
                shard, room = shard + 1, most
            first[c], room = shard, room - n
        return Shards(first, spread, shard + 1)


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1)


def search_shard(index: Index, ids: np.ndarray, x: np.ndarray, tails: dict[int, np.ndarray], cells: np.ndarray, codes: np.ndarray, qids: np.ndarray,
                 q: np.ndarray, qtails: dict[int, np.ndarray], probed: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, neighbours' ids, inner products) of each query among the shard's rows in its probed cells, best k. tails:
    by place, the components beyond the index's width.

    Candidates are the k x DEPTH rows of the largest estimates, ties to smaller ids; products are summed the same way
    for every row, so that equal vectors get equal scores."""
    order = np.lexsort((ids, cells))
    ids, x, cells, flat = ids[order], x[order], cells[order], codes[order].astype(np.int32) + np.arange(index.parts, dtype=np.int32) * CODES
    tails = {i: tails[o] for i, o in enumerate(order.tolist()) if o in tails} if tails else {}
    present, starts = np.unique(cells, return_index=True)
    ends = np.append(starts[1:], len(cells))
    for block in range(0, len(q), 256):
        part = q[block:block + 256]
        tables = np.zeros((len(part), index.parts, CODES), np.float32)
        for j, (sub, book) in enumerate(zip(index.cut(part), index.books, strict=True)):
            tables[:, j, :len(book)] = sub @ book.T
        for i in range(len(part)):
            at = block + i
            mine = np.flatnonzero(np.isin(present, probed[at]))
            if not len(mine):
                continue
            rows = np.concatenate([np.arange(starts[m], ends[m]) for m in mine])
            rows = rows[ids[rows] != qids[at]]
            if not len(rows):
                continue
            guess = tables[i].ravel()[flat[rows]].sum(1) + (index.centres[present[mine]] @ part[i])[np.searchsorted(present[mine], cells[rows])]
            if len(rows) > k * DEPTH:
                bound = np.partition(guess, len(rows) - k * DEPTH)[len(rows) - k * DEPTH]
                above, tied = rows[guess > bound], rows[guess == bound]
                rows = np.concatenate([above, tied[np.argsort(ids[tied], kind="stable")][:k * DEPTH - len(above)]])
            score = (x[rows] * q[at]).sum(1)
            if at in qtails and tails:
                for j, row in enumerate(rows.tolist()):
                    if row in tails:
                        both = min(len(tails[row]), len(qtails[at]))
                        score[j] += (tails[row][:both] * qtails[at][:both]).sum()
            best = np.lexsort((ids[rows], -score))[:k]
            yield int(qids[at]), ids[rows[best]], score[best]


def valid_vector(vector: Column) -> Column:
    """Neither null nor zero, only finite components."""
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))
    ok = vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda e: e != 0)
    return F.coalesce(ok, F.lit(False))


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (inner product in double precision) of the k nearest found to each row
    of df for which queries holds, among all of df's rows but those of the query's own id.

    Rows whose id or vector is null, whose vector is zero or has a null or non-finite component take no part. Of vectors of
    several widths the product is that of the components which both have; the index sees the most common width, with zeros
    for what is missing. A repeated row counts once; ids are meant to be unique, and of a query's id with several vectors
    the least (by its bytes) asks. Fewer than k rows: all of them, as all cells are probed then. Other columns are ignored.
    Empty table: empty result."""
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), queries.alias("asked")).where(F.col("id").isNotNull() & valid_vector(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    width, total = widths[0][0], sum(r[1] for r in widths)
    tail = F.when(F.size("v") > width, F.slice("v", width + 1, F.greatest(F.size("v") - width, F.lit(1))))
    even = F.when(F.size("v") == width, F.col("v")).otherwise(F.slice(F.concat("v", F.array_repeat(F.lit(0.0), width)), 1, width))
    rows = rows.select("id", even.alias("v"), tail.alias("t"), "asked")
    few = max(sample, PER_CELL * cells_for(total))
    hashed = rows.select("v", F.xxhash64("id", "v").alias("h"))
    if few < total:
        hashed = hashed.where(F.pmod("h", F.lit(1 << 30)) < int(few / total * (1 << 30)))
    got = hashed.dropDuplicates(["h"]).select("h", F.col("v").cast("array<float>").alias("v")).toArrow()
    order = np.argsort(got.column(0).to_numpy(), kind="stable")
    index = fit_index(_matrix(got.column(1).combine_chunks(), np.float32)[order], total, k)
    held = spark.sparkContext.broadcast(index)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells, codes = held.value.encode(_matrix(batch.column(1)).astype(np.float32))
                cols = [*batch.columns, pa.array(cells), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "v", "t", "asked", "cell", "code"])

    table = durable(rows.mapInArrow(indexed, "id long, v array<double>, t array<double>, asked boolean, cell int, code binary"))
    sizes = np.zeros(len(index.centres), np.int64)
    rows_in = np.zeros(len(index.centres), np.int64)  # a repeated row is packed as often as it is there but counts once
    for cell, n, ids in table.groupBy("cell").agg(F.count("*"), F.count_distinct("id")).collect():
        rows_in[cell], sizes[cell] = n, ids
    shards = Shards.pack(rows_in, SHARD_ROWS)
    packed = spark.sparkContext.broadcast((sizes, shards))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query once for each shard that has rows of its probed cells, with those cells."""
        sizes_, shards_ = packed.value
        for batch in rows_of(batches, 1_024):
            of, to, which = [], [], []
            for i, cells in enumerate(held.value.probed(_matrix(batch.column(1)), sizes_, k + 1)):
                cells = cells[sizes_[cells] > 0]
                spread = shards_.spread[cells]
                each = np.repeat(cells, spread)
                shard = np.repeat(shards_.first[cells], spread) + np.arange(len(each)) - np.repeat(np.cumsum(spread) - spread, spread)
                by = np.argsort(shard, kind="stable")
                own, starts = np.unique(shard[by], return_index=True)
                of.append(np.full(len(own), i))
                to.append(own)
                which += np.split(each[by].astype(np.int32), starts[1:])
            at = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int64)), *(batch.column(c).take(at) for c in (0, 1, 2)), pa.array(which, pa.list_(pa.int32()))], names=["shard", "id", "v", "t", "cells"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards_ = packed.value[1]
        for batch in batches:
            cells, salts = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (4, 6))
            shard = shards_.first[cells] + salts % shards_.spread[cells]
            yield pa.RecordBatch.from_arrays([pa.array(shard), *(batch.column(c) for c in (0, 1, 2, 4, 5))], names=["shard", "id", "v", "t", "cell", "code"])

    asked = durable(table.where("asked").select("id", "v", "t").mapInArrow(sent, "shard long, id long, v array<double>, t array<double>, cells array<int>"))
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))  # 16 bytes a shard
    blocks = F.broadcast(blocks) if shards.count <= MOST_SHARDS else blocks
    stored = table.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(2**31))).mapInArrow(placed, "shard long, id long, v array<double>, t array<double>, cell int, code binary")
    stored = stored.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "v", "t", "cell", "code")
    asked = asked.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "v", "t", "cells")

    def found(own: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(q):
            own = own.assign(same=[v.tobytes() for v in own["v"]]).drop_duplicates(["id", "same"])
            q = q.assign(same=[v.tobytes() for v in q["v"]]).sort_values(["id", "same"], kind="stable").drop_duplicates("id")
            codes = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
            tails, qtails = ({i: t for i, t in enumerate(x["t"]) if t is not None} for x in (own, q))
            for qid, ids, score in search_shard(held.value, own["id"].to_numpy(), np.stack(own["v"]), tails, own["cell"].to_numpy(), codes,
                                                q["id"].to_numpy(), np.stack(q["v"]), qtails, list(q["cells"]), k):
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    hits = stored.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(found, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(embeddings: DataFrame) -> DataFrame:
    """The contract's result: the 20 nearest to every row whose vec_id is divisible by 20."""
    return nearest(embeddings, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
