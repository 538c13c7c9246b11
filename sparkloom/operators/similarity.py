"""Tiered overlap of a development and a benchmark table, and near-duplicate question groups."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from sparkloom.functions.justification import ratio
from sparkloom.functions.text import FOLDS, STOPWORDS, bigrams, canonical, content_tokens, let
from sparkloom.tables import durable

COMMON = 50_000  # items whose frequency counts: 1 MB
SAMPLE = 20_000  # texts from which the order of signatures is told; any order gives the same pairs
LOW = 52  # bits of an item or a signature below the number of its text in a slice
SLICE_TEXTS, SLICE_BYTES = 1 << (64 - LOW), 2 << 20
FILTER_BITS = 1 << 27  # 16 MB
TILE_BYTES, TILE_PAIRS = 64 << 20, 500_000
MORE, ANY = 8, 255  # signatures more than may be lost, in a hundred tokens; a number that asks for one in common
GRAM = 3  # characters of a run
BROADCAST_BYTES = 256 << 20


def _threshold(name: str, value: float) -> None:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must be between 0 and 1, got {value}")


def exact_pairs(dev: DataFrame, bench: DataFrame, id_col: str, prompt: str, ignore_empty: bool = False) -> DataFrame:
    """development_id and benchmark_id of equal canonical prompts (a-z and 0-9 only), compared by their SHA-256. Prompts
    without any such character are equal to each other unless ignore_empty."""
    a, b = (_digests(df, prompt, ignore_empty, F.col(id_col).alias(name)) for df, name in ((dev, "development_id"), (bench, "benchmark_id")))
    return a.join(b, "digest").select("development_id", "benchmark_id")


def exact_count(dev: DataFrame, bench: DataFrame, prompt: str, ignore_empty: bool = False) -> DataFrame:
    """One row, exact_prompt_overlap_count: the number of exact_pairs, which aren't listed for it."""
    a, b = (_digests(df, prompt, ignore_empty).groupBy("digest").agg(F.count("*").alias(name)) for df, name in ((dev, "na"), (bench, "nb")))
    return a.join(b, "digest").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).cast("long").alias("exact_prompt_overlap_count"))


def _digests(df: DataFrame, prompt: str, ignore_empty: bool, *more: Column) -> DataFrame:
    rows = df.select(*more, canonical(F.coalesce(F.col(prompt), F.lit(""))).alias("canonical"))
    names = [c for c in rows.columns if c != "canonical"]
    return (rows.where("canonical <> ''") if ignore_empty else rows).select(*names, F.unhex(F.sha2("canonical", 256)).alias("digest"))


def _sets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Distinct content tokens and bigrams of each text, as 64-bit hashes: what is joined and compared is numbers."""
    hashed = lambda items: F.array_distinct(F.transform(items, lambda x: F.xxhash64(x)))
    toks = df.select(F.col(id_col).alias("id"), content_tokens(F.coalesce(F.col(text), F.lit(""))).alias("seq"))
    return durable(toks.select("id", hashed(F.col("seq")).alias("token"), hashed(bigrams(F.col("seq"))).alias("bigram")))


def _prefixes(rows: DataFrame, keys: list[str], items: str, keep: Column) -> DataFrame:
    """keys and x: the first keep of each row's items in an order that all rows share, in which the commonest come last.

    Any shared order loses nothing. Only the COMMON items that most rows have are told apart by their number of rows, so
    that these, and not one row for each item of each row, are what is joined."""
    each = rows.select(*keys, keep.alias("keep"), F.explode(items).alias("x"))
    common = durable(each.groupBy("x").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "x").limit(COMMON))  # 16 bytes a row
    ranked = each.join(F.broadcast(common), "x", "left").groupBy(*keys).agg(
        F.max("keep").alias("keep"), F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "x"))).alias("xs"))
    return ranked.select(*keys, F.explode(F.slice("xs", F.lit(1), F.greatest("keep", F.lit(1)))).alias("e")).select(*keys, "e.x")


def _candidates(dev: DataFrame, bench: DataFrame, item: str, threshold: float) -> DataFrame:
    """Pairs of ids that may reach the threshold: sets of near sizes that share one of their rarest items. If two sets are
    that similar, the first |s| - ceil(threshold |s|) + 1 items of each, in any common order, share one."""
    rows = dev.withColumn("side", F.lit(0)).unionByName(bench.withColumn("side", F.lit(1))).select("side", "id", F.size(item).alias("n"), item)
    keep = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int") + 1)
    prefix = _prefixes(rows, ["side", "id", "n"], item, keep)
    a = prefix.where("side = 0").select(F.col("id").alias("a"), F.col("n").alias("na"), "x")
    b = prefix.where("side = 1").select(F.col("id").alias("b"), F.col("n").alias("nb"), "x")
    near = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    return a.join(b, "x").where(near).select("a", "b").distinct()


def _jaccard(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(x) + F.size(y) - both), F.lit(0.0))


def near_pairs(dev: DataFrame, bench: DataFrame, exact: DataFrame | None, id_col: str, text: str, lexical_threshold: float = 0.8, ngram_threshold: float = 0.8) -> DataFrame:
    """development_id, benchmark_id, token_jaccard and bigram_jaccard of the pairs that reach either threshold and aren't
    exact. A development text needs two distinct tokens; ids are meant to be unique on either side. Tokens are compared by
    64-bit hashes. exact None: those of exact_pairs, which then needn't be listed.

    Above 0.5 texts are found by _neighbours, else by single items."""
    _threshold("lexical_threshold", lexical_threshold)
    _threshold("ngram_threshold", ngram_threshold)
    if min(lexical_threshold, ngram_threshold) > 0.5:
        hit = _near_classes(dev, bench, id_col, text, lexical_threshold, ngram_threshold, equal=exact is not None)
        return hit if exact is None else hit.join(exact, ["development_id", "benchmark_id"], "left_anti")
    exact = exact_pairs(dev, bench, id_col, text) if exact is None else exact
    a, b = _sets(dev, id_col, text).where(F.size("token") >= 2), _sets(bench, id_col, text)
    pairs = _candidates(a, b, "token", lexical_threshold)
    if lexical_threshold > 0:
        more = _candidates(a, b, "bigram", ngram_threshold) if ngram_threshold > 0 else _candidates(a, b, "token", 0.0)
        pairs = pairs.unionAll(more).distinct()
    scored = (pairs.join(a.select(F.col("id").alias("a"), F.col("token").alias("ta"), F.col("bigram").alias("ga")), "a")
              .join(b.select(F.col("id").alias("b"), F.col("token").alias("tb"), F.col("bigram").alias("gb")), "b")
              .select(F.col("a").alias("development_id"), F.col("b").alias("benchmark_id"), _jaccard(F.col("ta"), F.col("tb")).alias("token_jaccard"), _jaccard(F.col("ga"), F.col("gb")).alias("bigram_jaccard")))
    hit = scored.where((F.col("token_jaccard") >= lexical_threshold) | (F.col("bigram_jaccard") >= ngram_threshold))
    return hit.join(exact, ["development_id", "benchmark_id"], "left_anti")


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair."""
    z = x * np.uint64(0x9E3779B97F4A7C15) + y
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_OTHERS = re.compile("[" + "".join(FOLDS) + "]")
_RANDOM = np.random.default_rng(5)
_BYTES = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
_STEP = 0x9E3779B97F4A7C15


@functools.lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2^64."""
    out = []
    for x in (_STEP, pow(_STEP, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _polynomials(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values from each start to each end."""
    size = 1 << max(16, len(values).bit_length())
    up, down = _powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:len(values)])])
    return _mixed((sums[ends] - sums[starts]) * down[starts], (ends - starts).astype(np.uint64))


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its canonical text's hash and its number of content tokens; and all content tokens' hashes. The tokens
    are those of functions.text."""
    raw = []
    for t in texts:
        t = t.lower()
        raw.append((t if t.isascii() else _OTHERS.sub(lambda m: FOLDS[m[0]], t)).encode("utf-8", "surrogatepass"))
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    limits = np.cumsum([len(x) + 1 for x in raw])
    edges = np.flatnonzero(np.diff(_TOKEN[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    h = _polynomials(_BYTES[data], starts, ends)
    bounds = np.searchsorted(starts, np.concatenate([[0], limits]))
    whole = _polynomials(h, bounds[:-1], bounds[1:])
    use = (ends - starts >= 4) & ~np.isin(h, _stop_hashes())
    kept = np.concatenate([[0], np.cumsum(use)])[bounds]
    return whole, np.diff(kept), h[use]


@functools.lru_cache
def _stop_hashes() -> np.ndarray:
    data = [np.frombuffer(w.encode(), np.uint8) for w in STOPWORDS]
    return np.concatenate([_polynomials(_BYTES[x], np.array([0]), np.array([len(x)])) for x in data])


def _slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The place of the first text and _hashed, of slices of at most SLICE_TEXTS texts and SLICE_BYTES or one text."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        begin = ends[at - 1] if at else 0
        to = min(len(texts), at + SLICE_TEXTS, max(at + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, "right"))))
        yield at, *_hashed(texts[at:to].to_pylist())
        at = to


def _distinct(x: np.ndarray) -> np.ndarray:
    """Its values in order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _items(lengths: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens and bigrams of texts: below the place of the text, LOW bits of a hash."""
    text, bits, cut = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths), np.uint64(LOW), np.uint64(64 - LOW)
    grams = text[1:] << bits | _mixed(h[:-1], h[1:]) >> cut
    return _distinct(text << bits | h >> cut), _distinct(grams[text[1:] == text[:-1]])


def _neighbours(lengths: np.ndarray, h: np.ndarray, lexical: float, ngram: float, common: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of texts and signatures, of which two texts that reach either threshold share as many as the lesser of the two
    texts' numbers says (1 if both are ANY); and a text's number and sizes, as _alike reads them. h: the texts' tokens, one
    after another, as 64-bit hashes; lengths: their number in each text; common, sorted, with the weights of common tokens.

    A text's distinct tokens stand in a circle by hash; each with the next w - 1 is a run. A token that only this text has
    breaks w of its runs, one that only the other has breaks w - 1, so of n runs at most w (1 - t) n are lost at a threshold
    t >= 1 - 1 / w, and in an order that all texts share the first of k more than that have k in common. The order begins with runs of
    rare tokens; with w = 3, texts that only share a subject or a passage seldom meet. Of k runs of bigrams at most
    w (1 - ngram) k are lost likewise; and a text has at most one more tokens of its own than bigrams of its own (a token's
    first place ends one, but in the first place), so that this and 2 w - 1 more runs of tokens are lost. Where that may be
    all runs, the text has runs of bigrams besides."""
    w = 3 if min(lexical, ngram) >= 0.75 else 2
    n, low, bits = len(lengths), np.uint64((1 << LOW) - 1), np.uint64(LOW)
    tokens, grams = _items(lengths, h)
    of_tokens, of_grams = (np.bincount((x >> bits).astype(np.int64), minlength=n) for x in (tokens, grams))
    lost_grams = np.floor(w * (1 - ngram) * of_grams + 1e-9).astype(np.int64)
    lost = np.maximum(np.floor(w * (1 - lexical) * of_tokens + 1e-9).astype(np.int64), lost_grams + 2 * w - 1)
    unsure = lost >= of_tokens
    more = np.minimum(np.minimum(1 + of_tokens * MORE // 100, of_tokens - lost), ANY - 1)

    def first(items: np.ndarray, sizes: np.ndarray, keep: np.ndarray, weigh: bool) -> np.ndarray:
        value, place, ends = items & low, (items >> bits).astype(np.int64), np.cumsum(sizes)
        after = np.arange(1, len(items) + 1)
        after[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
        weight = np.full(len(items), 255, np.uint64)
        if weigh:
            at = np.minimum(np.searchsorted(common, value), len(common) - 1)
            own = np.where(common[at] == value, weights[at], np.uint64(0)) if len(common) else np.zeros(len(items), np.uint64)
            weight = own
        run, at = value, after
        for _ in range(w - 1):
            run, weight, at = _mixed(run, value[at]), weight + own[at] if weigh else weight, after[at]
        made = np.sort(items & ~low | weight << np.uint64(LOW - 8) | run >> np.uint64(72 - LOW))
        return made[np.arange(len(made)) - (ends - sizes)[place] < keep[place]]

    some = np.where(of_tokens >= 2, np.where(unsure, of_tokens, lost + more), 0)
    doubt = unsure[(grams >> bits).astype(np.int64)]
    out = np.concatenate([first(tokens, of_tokens, some, True), first(grams[doubt], np.where(unsure, of_grams, 0), np.where(of_tokens >= 2, lost_grams + 1, 0), False)])
    size = lambda x: np.floor(16 * np.log2(np.maximum(x, 1))).astype(np.int32)
    told = (size(of_tokens) * 512 + size(of_grams)) * 256 + np.where(unsure, ANY, more).astype(np.int32)
    return (out >> bits).astype(np.int64), (out & low).astype(np.int64), told


def _alike(x: Column, y: Column, lexical: float, ngram: float) -> Column:
    """Whether the sizes that _neighbours gives two texts let them reach either threshold."""
    near = lambda of, t: F.abs(of(x) - of(y)) <= math.floor(-16 * math.log2(t)) + 1
    return near(lambda q: F.shiftright(q, 17), lexical) | near(lambda q: F.shiftright(q, 8).bitwiseAND(F.lit(511)), ngram)


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest tokens (the upper LOW bits of their hashes) of SAMPLE texts and five times the logarithm of their number: under 85 each."""
    share = min(1.0, SAMPLE / max(1, rows.count()))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, lengths, h in _slices(batch.column(0)):
                x = _distinct(np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths) << np.uint64(LOW) | h >> np.uint64(64 - LOW))
                yield pa.RecordBatch.from_arrays([pa.array((x & np.uint64((1 << LOW) - 1)).astype(np.int64))], names=["x"])

    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counts = some.mapInArrow(listed, "x long").groupBy("x").count().where("count > 1")
    got = counts.orderBy(F.desc("count"), "x").limit(COMMON).orderBy("x").toArrow()
    return got["x"].to_numpy().astype(np.uint64), (5 * np.log2(got["count"].to_numpy() + 1.0)).astype(np.uint64)


def _held(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with the texts of its ids. A filter of FILTER_BITS keeps most of the others out before texts are shuffled."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits, size = np.zeros(FILTER_BITS // 8, np.uint8), 1 << 15  # bits of a part
    parts = wanted.select(place.alias("p")).groupBy(F.floor(F.col("p") / size).alias("k")).agg(F.bitmap_construct_agg(F.col("p") % size).alias("bits"))
    for k, part in parts.collect():
        bits[k * (size // 8):(k + 1) * (size // 8)] = np.frombuffer(part, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy()
            yield batch.filter(pa.array(sent.value[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1))

    placed = rows.select(place.alias("p"), "id", "text")
    return placed.mapInArrow(passed, placed.schema).drop("p").join(wanted, "id")


def _scored_tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Jaccards of a tile's pairs (side 2: c, d) by its texts (side 0: of development, 1: of benchmark; c: the class)."""
    rows = rows.combine_chunks()
    side, c, d = (rows[x].to_numpy() for x in ("side", "c", "d"))
    of, pairs = np.flatnonzero(side < 2), np.flatnonzero(side == 2)
    pairs = pairs[np.argsort(c[pairs], kind="stable")]
    whole, items, sizes = [], ([], []), ([], [])
    for _, own, lengths, h in _slices(rows["text"].combine_chunks().take(pa.array(of))):
        whole.append(own.view(np.int64))
        for k, x in enumerate(_items(lengths, h)):
            items[k].append(x & np.uint64((1 << LOW) - 1))
            sizes[k].append(np.bincount((x >> np.uint64(LOW)).astype(np.int64), minlength=len(own)))
    right = np.concatenate(whole) == c[of]  # else another text of a repeated id
    a, b = (np.flatnonzero((side[of] == k) & right) for k in range(2))
    a, b = a[np.argsort(c[of][a])], b[np.argsort(c[of][b])]
    at_a, at_b = a[np.searchsorted(c[of][a], c[pairs])], b[np.searchsorted(c[of][b], d[pairs])]
    bounds = np.flatnonzero(np.diff(c[pairs], prepend=c[pairs][:1] - 1, append=c[pairs][-1:] + 1))
    out = {"c": pa.array(c[pairs]), "d": pa.array(d[pairs])}
    for name, lists, counts in zip(("token", "bigram"), items, sizes, strict=True):
        count, (known, item) = np.concatenate(counts), np.unique(np.concatenate(lists), return_inverse=True)
        ends, seen, both = np.cumsum(count), np.zeros(len(known), bool), np.zeros(len(pairs), np.int64)
        starts = ends - count
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            own = item[starts[at_a[x]]:ends[at_a[x]]]
            seen[own] = True
            for z in range(x, y):
                both[z] = np.count_nonzero(seen[item[starts[at_b[z]]:ends[at_b[z]]]])
            seen[own] = False
        out[name] = pa.array(both / np.maximum(count[at_a] + count[at_b] - both, 1))
    return pa.table(out)


def _near_classes(dev: DataFrame, bench: DataFrame, id_col: str, text: str, lexical: float, ngram: float, equal: bool) -> DataFrame:
    """near_pairs at thresholds above 0.5, with exact pairs if equal. Texts of equal canonical texts are one class; classes
    that share enough signatures (_neighbours) are compared by a text of each, and only these texts are shuffled, to tiles:
    those that have the same least class as a neighbour go together, in several tiles if they or their pairs are too many
    for one. Then classes are expanded into texts."""
    sides = [df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")) for df in (dev, bench)]
    sent = dev.sparkSession.sparkContext.broadcast(_common(sides[0].unionAll(sides[1])))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, whole, _, _ in _slices(batch.column(1)):
                held = slice(at, at + len(whole))
                yield pa.RecordBatch.from_arrays([batch.column(0)[held], pa.array(whole.view(np.int64)), pc.binary_length(batch.column(1)[held]).cast(pa.int64())], names=["id", "c", "size"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, whole, lengths, h in _slices(batch.column(0)):
                places, signs, told = _neighbours(lengths, h, lexical, ngram, *sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(signs), pa.array(whole.view(np.int64)[places]), pa.array(told[places])], names=["s", "c", "q"])

    members = [durable(x.mapInArrow(keyed, f"id {x.schema['id'].dataType.simpleString()}, c long, size long")) for x in sides]
    a, b = (x.select("text").mapInArrow(signed, "s long, c long, q int").repartition("s").distinct() for x in sides)
    both = a.join(b.select("s", F.col("c").alias("d"), F.col("q").alias("r")), "s").where(_alike(F.col("q"), F.col("r"), lexical, ngram))
    least = F.least(F.col("q").bitwiseAND(F.lit(255)), F.col("r").bitwiseAND(F.lit(255)))
    pairs = (both if equal else both.where("c <> d")).groupBy("c", "d").agg(F.count("*").alias("n"), F.max(F.when(least == ANY, 1).otherwise(least)).alias("least"))
    pairs = durable(pairs.where("n >= least").select("c", "d"))

    led = pairs.join(pairs.groupBy("d").agg(F.min("c").alias("lead")), "d")
    chosen = []
    for rest, name in zip(members, "cd", strict=True):
        wanted = led.groupBy(F.col(name).alias("c")).agg(F.min("lead").alias("lead"))
        chosen.append(durable(rest.join(wanted, "c").groupBy("c").agg(F.min(F.struct("id", "size")).alias("e"), F.first("lead").alias("lead")).select("c", "e.id", "e.size", "lead")))
    sizes = chosen[0].select("lead", "size").unionAll(chosen[1].select("lead", "size")).groupBy("lead").agg(F.sum("size").alias("size"))
    of_lead = led.groupBy("lead").agg(F.count("*").alias("n")).join(sizes, "lead", "left")
    n = F.ceil(F.greatest(F.coalesce("size", F.lit(0)) / TILE_BYTES, F.sqrt(F.col("n") / TILE_PAIRS)))
    tiles = max(12, -(-(sizes.agg(F.sum("size")).first()[0] or 0) * 8 // TILE_BYTES))
    part = lambda x: F.pmod(F.xxhash64(x), F.col("m"))
    tile = F.when(F.col("m") == 1, F.pmod(F.xxhash64("lead"), F.lit(tiles))).otherwise(F.xxhash64("lead", part("c"), part("d"))).alias("tile")
    tiled = durable(led.join(of_lead.select("lead", n.alias("m")), "lead").select(tile, "c", "d"))
    parts = tiled.select("tile", F.lit(2).alias("side"), "c", "d", F.lit(None).cast("string").alias("text"))
    for i, (rows, x, name) in enumerate(zip(sides, chosen, "cd", strict=True)):
        wanted = tiled.select("tile", F.col(name).alias("c")).distinct().join(x.select("c", "id"), "c")
        parts = parts.unionAll(_held(rows, wanted).select("tile", F.lit(i).alias("side"), "c", F.lit(0).cast("long").alias("d"), "text"))
    scored = parts.groupBy("tile").applyInArrow(_scored_tile, "c long, d long, token double, bigram double")
    hit = scored.where((F.col("token") >= lexical) | (F.col("bigram") >= ngram))
    of = [x.select(F.col("id").alias(name), F.col("c").alias(key)) for x, name, key in zip(members, ("development_id", "benchmark_id"), "cd", strict=True)]
    return hit.join(of[0], "c").join(of[1], "d").select("development_id", "benchmark_id", F.col("token").alias("token_jaccard"), F.col("bigram").alias("bigram_jaccard"))


def cosine(x: Column, y: Column) -> Column:
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))


def semantic_pairs(dev: DataFrame, bench: DataFrame, blocked: DataFrame, id_col: str, value: str, scorer: Callable[[Column, Column], Column],
                   threshold: float = 0.9, block_rows: int = 2_000) -> DataFrame:
    """Pairs that no other tier has and that scorer (a column function into [0, 1]) puts at the threshold or above.

    The benchmark is a stated query set: it is sent to the tasks in blocks of bounded rows and compared with all
    development rows; a score out of [0, 1] raises."""
    _threshold("semantic_threshold", threshold)
    b = bench.select(F.col(id_col).alias("benchmark_id"), F.col(value).alias("y"))
    a = dev.select(F.col(id_col).alias("development_id"), F.col(value).alias("x"))
    parts, out = max(1, -(-b.count() // block_rows)), None
    for i in range(parts):
        block = b.where(F.pmod(F.xxhash64("benchmark_id"), F.lit(parts)) == i).agg(F.collect_list(F.struct("benchmark_id", "y")).alias("block"))
        pairs = a.join(F.broadcast(block)).select("development_id", "x", F.explode("block").alias("e")).select("development_id", "x", "e.benchmark_id", "e.y")
        score = scorer(F.col("x"), F.col("y"))
        checked = F.when(score.between(0, 1), score).otherwise(F.raise_error(F.lit("semantic similarity must be between 0 and 1")))
        hit = pairs.withColumn("semantic_similarity", checked).where(F.col("semantic_similarity") >= threshold).select("development_id", "benchmark_id", "semantic_similarity")
        out = hit if out is None else out.unionAll(hit)
    return out.join(blocked, ["development_id", "benchmark_id"], "left_anti")


def matrix_pairs(dev: DataFrame, bench: DataFrame, blocked: DataFrame, id_col: str, vector: str, scorer: Callable[[np.ndarray, np.ndarray], np.ndarray],
                 threshold: float = 0.9, block_rows: int = 2_000) -> DataFrame:
    """semantic_pairs for scorers of two matrices (a row each of development and benchmark): a score for each pair of rows.

    The benchmark's vectors, a stated query set, are sent to the tasks whole if they have at most BROADCAST_BYTES, else in
    as many parts, each of which reads the development rows once more; a task compares a batch with block_rows of them at
    a time. Null vectors and null ids match nothing."""
    _threshold("semantic_threshold", threshold)
    held = bench.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = dev.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    schema = f"development_id {dev.schema[id_col].dataType.simpleString()}, benchmark_id {bench.schema[id_col].dataType.simpleString()}, semantic_similarity double"
    parts = max(1, -(-(held.agg(F.sum(8 * F.size("v"))).first()[0] or 0) // BROADCAST_BYTES))
    out = dev.sparkSession.createDataFrame([], schema)
    stack = lambda c: np.asarray(c.flatten().to_numpy(zero_copy_only=False), float).reshape(len(c), -1)
    for i in range(parts):
        got = held.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        ids, vectors = got.column(0).combine_chunks(), stack(got.column(1).combine_chunks())
        sent = dev.sparkSession.sparkContext.broadcast((ids, vectors))

        def scored(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            for batch in batches:
                own = stack(batch.column(1)) if batch.num_rows else np.empty((0, vectors.shape[1]))
                for at in range(0, len(vectors) if len(own) else 0, block_rows):
                    scores = scorer(own, vectors[at:at + block_rows])
                    if not ((scores >= 0) & (scores <= 1)).all():
                        raise ValueError("semantic similarity must be between 0 and 1")
                    x, y = np.nonzero(scores >= threshold)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x)), ids.take(pa.array(at + y)), pa.array(scores[x, y])], names=["development_id", "benchmark_id", "semantic_similarity"])

        out = out.unionAll(rows.mapInArrow(scored, schema))
    return out.join(blocked, ["development_id", "benchmark_id"], "left_anti")


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, moved from [-1, 1] into [0, 1]; zero vectors are unlike any."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return np.clip(unit(x) @ unit(y).T / 2 + 0.5, 0.0, 1.0)


def ranked(pairs: DataFrame, *scores: str) -> DataFrame:
    """Pairs in a report's order: the greatest of the scores first, then by the two ids. Sorts all pairs."""
    best = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    return pairs.orderBy(F.desc(best), "development_id", "benchmark_id")


def leakage_summary(dev: DataFrame, bench: DataFrame, exact: DataFrame, near: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """One row of the tiers' counts and whether all are empty. exact: pairs, or exact_count's row."""
    n = lambda df, name: df if df.columns == [name] else df.agg(F.count("*").alias(name))
    out = n(dev, "development_examples").crossJoin(n(bench, "benchmark_examples")).crossJoin(n(exact, "exact_prompt_overlap_count")).crossJoin(n(near, "high_lexical_similarity_count"))
    out = out.crossJoin(n(semantic, "high_semantic_similarity_count")) if semantic is not None else out.withColumn("high_semantic_similarity_count", F.lit(0).cast("long"))
    counts = ("exact_prompt_overlap_count", "high_lexical_similarity_count", "high_semantic_similarity_count")
    return out.withColumn("semantic_enabled", F.lit(semantic is not None)).withColumn("passed", sum(F.col(c) for c in counts) == 0)


@pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio, or null where the letters in common already rule the least one out."""

    def of(a: str, b: str, t: float) -> float | None:
        if not a and not b:
            return 1.0
        common = sum(min(n, b.count(ch)) for ch in set(a) if (n := a.count(ch)))
        return ratio(a, b) if 2 * common >= t * (len(a) + len(b)) else None

    return pd.Series([of(a, b, t) for a, b, t in zip(left, right, least, strict=True)], dtype="float64")


def near_duplicate_groups(rows: DataFrame, group: str, text: str, ordinal: str, threshold: float = 0.94) -> DataFrame:
    """left_group < right_group and similarity of groups whose first texts are alike.

    The ratio is 2M / (a + b) for M characters in matching blocks. With e = a + b - 2M characters left over there are at
    most e + 1 blocks, each of which but for GRAM - 1 of its characters begins a run of GRAM characters that both texts
    have; so two texts that reach the threshold share a number of runs that grows with their length, and one of their
    rarest (the k-th occurrence of a run counts as a run of its own). Texts too short for that are compared by length
    alone. The ratio itself runs in Arrow batches on what the letters in common don't rule out."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    first = durable(rows.groupBy(F.col(group).alias("g")).agg(F.min_by(F.col(text), F.col(ordinal)).alias("t")).withColumn("n", F.length("t")))
    shortest = threshold / (2 - threshold)  # of a partner, as a share of the length
    total = F.col("n") * (1 + shortest)
    least = F.floor(total * (threshold / 2 - (1 - threshold) * (GRAM - 1)) - (GRAM - 1) + 1e-9).cast("int")
    sized = first.withColumn("least", least)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - (GRAM - 1), F.lit(1))), lambda i: F.substring(F.col("t"), i, F.lit(GRAM)))
    counted = F.aggregate(F.array_sort(grams), F.struct(F.lit("").alias("last"), F.lit(0).alias("k"), F.array().cast("array<bigint>").alias("out")), lambda acc, x: let(
        F.when(x == acc["last"], acc["k"] + 1).otherwise(0), lambda k: F.struct(x.alias("last"), k.alias("k"), F.concat(acc["out"], F.array(F.xxhash64(x, k))).alias("out"))), lambda acc: acc["out"])
    runs = sized.where("least >= 1").select("g", "n", (F.col("n") - (GRAM - 1) - F.col("least") + 1).alias("keep"), counted.alias("runs"))
    prefix = _prefixes(runs, ["g", "n"], "runs", F.col("keep"))
    near = F.least("n", "m") >= shortest * F.greatest("n", "m") - 1e-9
    by_run = prefix.join(prefix.select(F.col("g").alias("h"), F.col("n").alias("m"), "x"), "x").where((F.col("g") < F.col("h")) & near).select("g", "h").distinct()
    short = sized.where("least < 1").select("g", "n")
    reach = F.explode(F.sequence(F.ceil(F.col("n") * shortest - 1e-9).cast("int"), F.floor(F.col("n") / shortest + 1e-9).cast("int"))).alias("m")
    by_length = short.select("g", reach).join(sized.select(F.col("g").alias("h"), F.col("n").alias("m")), "m").where(F.col("g") != F.col("h")).select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()
    pairs = by_run.unionAll(by_length).distinct().join(first.select("g", "t"), "g").join(first.select(F.col("g").alias("h"), F.col("t").alias("u")), "h")
    scored = pairs.select(F.col("g").alias("left_group"), F.col("h").alias("right_group"), _ratio(F.col("t"), F.col("u"), F.lit(threshold)).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)
