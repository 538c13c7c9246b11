"""SimHash near-dedup: fingerprints of 3-word shingles, linked at a Hamming distance through BK-trees.

Fingerprints are dealt to shards by blocks of their bits. Two that differ in at most 2 of 64 bits agree on 2 of 4
blocks at least, so each goes to 6 shards (a pair of blocks and its 32 bits) and meets every partner in one of them.
A shard of more than SHARD fingerprints is dealt again by its other 32 bits in the same way: by pairs of 4 blocks of 8
bits. So no shard holds more than 2^16 fingerprints, whatever the corpus.
In a shard a BK-tree (children keyed by their Hamming distance to the parent) is built and searched along the edges
within the radius. Shards, not trees of all the corpus, travel: the trees' total size grows with the input, so that
they are sent by a shuffle where a broadcast would have no bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import durable, rows_of, text_or_empty, tmp, words_of
from sparkloom.llm.graph import component_roots

WORDS = 3
RADIUS = 2
BLOCKS = 4  # agreement on BLOCKS - RADIUS blocks is certain
SEED = 42
CHUNK = 65_536
SHARD = 8_192  # fingerprints of a shard that isn't dealt again
HOT = 100_000  # rows of one fingerprint that aren't dealt by it
HOT_KEYS = 500_000  # such fingerprints that are broadcast: some 50 MB


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bit i is 1 if it is 1 in over half the shingles' XXH64; repeats count. No words: 0; fewer than words: one shingle."""
    w = words_of(text)
    if not w:
        return 0
    shingles = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [tuple(w)]
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        ones += np.unpackbits(h[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            at, value = 0, values[i]
            while (nxt := self.children[at].setdefault((values[at] ^ value).bit_count(), i)) != i:
                at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at that distance or less."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if kids:
                open_ += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids]
        return found

    def pairs(self, radius: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, found) for all values as queries: the same walk, many queries a step."""
        values = np.array(self.values, np.uint64)
        edges = np.full((len(values), 65 + 2 * radius), -1, np.int32)
        for i, kids in enumerate(self.children):
            for d, j in kids.items():
                edges[i, d + radius] = j
        for first in range(0, len(values), block):
            q = np.arange(first, min(first + block, len(values)))
            at = np.zeros(len(q), np.int32)
            while len(q):
                d = np.bitwise_count(values[q] ^ values[at]).astype(np.int64)
                hit = d <= radius
                yield q[hit], at[hit]
                kids = edges[at[:, None], d[:, None] + np.arange(2 * radius + 1)]
                rows, cols = np.nonzero(kids >= 0)
                q, at = q[rows], kids[rows, cols]


def linked(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, least value of its component) for the values of one shard that have a link."""
    tree, parent = BKTree(values), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            if values[a] > values[b]:
                a, b = b, a
            parent[b] = a

    if len(values) <= 64:
        for i, value in enumerate(values):
            for j in tree.within(value, radius):
                join(i, j)
    else:
        for q, found in tree.pairs(radius):
            for i, j in zip(q.tolist(), found.tolist(), strict=True):
                if i < j:
                    join(i, j)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def _links(radius: int):
    def of(run: np.ndarray) -> list[tuple[int, int]]:
        return linked(np.unique(run).view(np.uint64).tolist(), radius)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard; a shard may go on in the next batch."""
        shard, parts = None, []
        for batch in batches:
            keys, values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, int)
            ends = np.append(starts[1:], len(keys))
            out: list[tuple[int, int]] = []
            long = [i for i in range(len(starts)) if ends[i] - starts[i] > 1 or i in (0, len(starts) - 1)]
            for i in long:
                run = values[starts[i]:ends[i]]
                if keys[starts[i]] != shard:
                    out += of(np.concatenate(parts)) if parts else []
                    shard, parts = keys[starts[i]], []
                parts.append(run)
            yield _edges(out)
        yield _edges(of(np.concatenate(parts)) if parts else [])

    return links


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], names=["u", "v"])


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's 64 bits as a long) of every row, written to the shared folder."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            fp = np.fromiter((fingerprint(t, words) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    text = text_or_empty(F.col(text_col))
    kind = df.schema[id_col].dataType.simpleString()
    return durable(df.select(F.col(id_col), F.xxhash64(text), text.cast("binary")).mapInArrow(hashed, f"doc_id {kind}, text_hash long, fp long"))


def _blocks(value: Column, bits: int) -> list[Column]:
    """The blocks of a value of that many bits."""
    width = bits // BLOCKS
    return [F.shiftrightunsigned(value, width * i).bitwiseAND(F.lit(2**width - 1)) for i in range(BLOCKS)]


def _dealt(distinct: DataFrame, most: int) -> DataFrame:
    """(shard, fp): each fingerprint in the six shards of its pairs of blocks; of a shard above most, in the six of each of
    these that the pairs of blocks of its other bits make."""
    pairs = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
    block = _blocks(F.col("fp"), 64)
    shards = [F.lit(k << 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for k, (i, j) in enumerate(pairs)]
    dealt = distinct.select(F.explode(F.array(*shards)).alias("shard"), "fp")
    large = durable(dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most).select("shard"))
    few = large.count()
    if not few:
        return dealt
    large = F.broadcast(large) if few <= HOT_KEYS else large
    others = [[i for i in range(BLOCKS) if i not in pair] for pair in pairs]
    rest = F.element_at(F.array(*(F.shiftleft(block[i], 16).bitwiseOR(block[j]) for i, j in others)), F.shiftright("shard", 32).cast("int") + 1)
    part = _blocks(rest, 32)
    again = [F.lit((k + 1) << 51).bitwiseOR(F.shiftleft("shard", 16)).bitwiseOR(F.shiftleft(part[i], 8)).bitwiseOR(part[j]) for k, (i, j) in enumerate(pairs)]
    small = dealt.join(large, "shard", "left_anti").select("shard", "fp")
    return small.unionByName(dealt.join(large, "shard", "left_semi").select(F.explode(F.array(*again)).alias("shard"), "fp"))


def components(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """fp, n (its rows) and first (struct of none, doc_id, text_hash: the component's least row, null ids last) for every distinct fp."""
    distinct = durable(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")))
    dealt = _dealt(distinct, shard).repartition("shard").sortWithinPartitions("shard")
    roots = component_roots(dealt.mapInArrow(_links(radius), "u long, v long"))
    rooted = distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", "n", "first", F.coalesce("v", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.drop("first").join(firsts, "root").select("fp", "n", "first")


def simhash_near_dups(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of every row of df.

    Null text: empty, fingerprint zero, which links like any other. Null ids: never a component_id unless all of the
    component's are null. Equal rows share all results. Empty table: empty result. Only radius 2 is built."""
    if radius != RADIUS:
        raise ValueError("shards are dealt for a radius of 2")
    prints = fingerprints(df, text_col, id_col, words)
    found = durable(components(prints, radius).select("fp", "n", F.col("first.doc_id").alias("least")))
    hot = found.where(F.col("n") > HOT).select("fp", F.col("least").alias("hot"), F.lit(True).alias("told"))
    few = hot.count()
    if 0 < few <= HOT_KEYS:  # the rows of a frequent fingerprint stay where they are
        marked = prints.join(F.broadcast(hot), "fp", "left")
        rest = marked.where(F.col("told").isNull()).select("doc_id", "fp").join(found, "fp").select("doc_id", "fp", "least")
        out = rest.unionByName(marked.where("told").select("doc_id", "fp", F.col("hot").alias("least")))
    else:
        out = prints.join(found, "fp")
    return out.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df's rows with one row of each component: the one of the least id (nulls last), once if it is repeated."""
    firsts = components(fingerprints(df, text_col, id_col)).select("first").distinct()
    none, own, text = tmp("none"), tmp("id"), tmp("hash")
    key = lambda id_, hash_: [id_.isNull().alias(none), F.coalesce(id_.cast("string"), F.lit("")).alias(own), hash_.alias(text)]
    kept = firsts.select(*key(F.col("first.doc_id"), F.col("first.text_hash")))
    keyed = df.select("*", *key(F.col(id_col), F.xxhash64(text_or_empty(F.col(text_col)))))
    return keyed.join(kept, [none, own, text], "left_semi").dropDuplicates([none, own, text]).select(*df.columns)


def op1_simhash(documents: DataFrame) -> DataFrame:
    """The contract's result over all documents; null ids and texts, repeated rows and empty tables as there."""
    return simhash_near_dups(documents)
