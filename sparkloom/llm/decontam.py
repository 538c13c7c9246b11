"""Benchmark decontamination by latent semantic retrieval and a check of word order and answer.

All passages of the corpus and the benchmark, over the benchmark's vocabulary, make a TF-IDF matrix A. One pass over the
corpus gives the document frequencies and T'(T R) for term counts T and random signs R: with D = diag(idf) and the test
matrix R / idf that is the sketch A'A(R / idf) = D T'(T R) of the randomised SVD, whose orthonormal basis spans the latent
space. A second pass compares windows of every text with the benchmark's passages by cosine in that space; a candidate is
a leak if a longest common subsequence holds enough of the passage's words and enough of its answer. Candidates in a unit
of text with too few of the passage's distinct words for that are let go together, others by their own words. Two passes
serve a benchmark of any size. A benchmark is held by the driver and the tasks: some 1 KB for each of its distinct words.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.llm.common import rows_of, tmp

#: Words are what remains between ASCII punctuation and the marks and spaces of three Unicode blocks.
MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb-\u00bf\u2000-\u206f\u3000-\u303f]")
ASCII = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
BLOCK = 4  # words whose vectors are summed first; windows start at each
SCALES = (16, 24, 32, 48, 64)  # windows' words; a passage is compared at the least that holds it
STEP = 32  # words between the passages of an item that is longer than the last scale
RANK = 96
COSINE = (0.35, 0.35, 0.4, 0.4, 0.4)  # candidates, by scale: at least three standard deviations of unrelated windows
COMMON = 0.65  # of a passage's words in the common subsequence
ANSWER = 0.6  # of the answer's words among those
REACH = 32  # words looked at on either side of a window
COLUMNS = 2_048  # passages compared at a time
PIECE = 1 << 19  # bytes of text compared at a time, or one text
STRIP = 2_048  # blocks compared at a time, so that their sums stay in a cache
UNIT = 256  # words, at least a window and twice REACH; a passage is looked for in a unit before it is in the unit's windows
OFTEN = 32  # occurrences of a term in a piece from which on they are summed by themselves
#: By scale the sums of blocks that it and later ones are made of; the others are let go.
KEPT = {16: (1, 2, 4), 24: (2, 4, 6), 32: (4, 8), 48: (4, 8, 12), 64: (8, 16)}


def _pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = 64) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most that many and at most PIECE bytes of text (or one row), so that very long texts don't meet."""
    for batch in rows_of(batches, most):
        first, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
            if i > first and size + (n or 0) > PIECE:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += n or 0
        yield batch.slice(first)


def tokens(text: str | None) -> list[bytes]:
    low = (text or "").lower()
    if not low.isascii():
        low = MARKS.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(ASCII).split()


@dataclass
class Passage:
    """Words in a row of a benchmark item, as terms, and the terms that are its answer."""

    key: object  # the item's
    terms: list[int]
    answer: set[int]

    def __post_init__(self) -> None:
        self.masks: dict[int, int] = {}
        for i, t in enumerate(self.terms):
            self.masks[t] = self.masks.get(t, 0) | 1 << i


def _codes(terms: dict[bytes, int]) -> dict[bytes, bytes]:
    """The terms as the bytes of an int32: joined, they make an array sooner than integers do."""
    return {w: i.to_bytes(4, sys.byteorder) for w, i in terms.items()}


def _encode(texts: list[str | None], codes: dict[bytes, bytes], whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all words, each text padded to a multiple of whole; the first word of each text. Words of no term: len(codes)."""
    get, none = codes.get, len(codes).to_bytes(4, sys.byteorder)
    parts, starts, at = [], [], 0
    for text in texts:
        found = b"".join(map(get, tokens(text), repeat(none)))
        padded = max(1, -(-len(found) // (4 * whole))) * whole
        parts += found, none * (padded - len(found) // 4)
        starts.append(at)
        at += padded
    return np.frombuffer(b"".join(parts), np.int32), np.array(starts, np.int64)


def _sketch(ids: np.ndarray, signs: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, passages that have each, rows of T'(T R)) for passages of that many words, under 128; signs' last row is zero."""
    count, none = len(ids) // passage, len(signs) - 1
    y = np.empty((count, signs.shape[1]), np.int32)
    for at in range(0, count, 256):
        some = signs.take(ids[at * passage:(at + 256) * passage], 0, mode="clip")
        y[at:at + 256] = some.reshape(-1, passage, signs.shape[1]).sum(1, dtype=np.int8)
    known = np.flatnonzero(ids != none)
    key = np.sort(ids[known].astype(np.int64) * max(1, count) + known // passage)
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, signs.shape[1]))
    of, at = key // count, key % count
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    order = np.argsort(-sizes, kind="stable")  # terms by their number of rows of y, so that the k-th rows of all are added at once
    first, sizes = starts[order], sizes[order]
    sums = np.empty((len(starts), signs.shape[1]), np.int32)
    often = int(np.searchsorted(-sizes, -OFTEN))
    for i in range(often):
        np.add.reduce(y.take(at[first[i]:first[i] + sizes[i]], 0, mode="clip"), axis=0, out=sums[i])
    sums[often:] = y.take(at[first[often:]], 0, mode="clip")
    for k in range(1, OFTEN):
        more = int(np.searchsorted(-sizes, -k))
        if more <= often:
            break
        sums[often:more] += y.take(at[first[often:more] + k], 0, mode="clip")
    out = np.empty(sums.shape)
    out[order] = sums
    return of[starts], np.add.reduceat(fresh.astype(np.int64), starts), out


def _basis(idf: np.ndarray, sums: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """V / S of A's singular triples U S V', from the one-pass sketch: A'A ~ Z (R' T'T R)^-1 Z' with Z = A'A(R / idf).

    Dividing by S makes rows of U of passages, so that the few directions which all texts share don't rule cosines."""
    q, r = np.linalg.qr(idf[:, None] * sums)
    out = np.zeros((len(idf), signs.shape[1]))
    if len(idf):
        square = r @ np.linalg.pinv(signs.T.astype(np.float64) @ sums, rcond=1e-10, hermitian=True) @ r.T
        values, vectors = np.linalg.eigh((square + square.T) / 2)
        kept = values > max(1e-9, 1e-6 * values[-1])
        found = q @ vectors[:, kept] / np.sqrt(values[kept])
        out[:, :found.shape[1]] = found
    return out


def signs_of(terms: int, rank: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed).integers(0, 2, (terms + 1, rank)).astype(np.int8) * 2 - 1
    r[-1] = 0
    return r


def _windows(sums: dict[int, np.ndarray], k: int) -> np.ndarray:
    """Sums of k rows from each row of sums[1] on (of what there is at the end), made of those of fewer rows."""
    if k not in sums:
        top = 1 << (k - 1).bit_length() - 1
        most, rest = _windows(sums, top), _windows(sums, k - top)
        out, whole = np.empty_like(most), max(0, len(most) - top)
        np.add(most[:whole], rest[top:], out=out[:whole])
        out[whole:] = most[whole:]
        sums[k] = out
    return sums[k]


@dataclass
class Search:
    """What a task needs to compare texts with the benchmark's passages."""

    terms: dict[bytes, int]
    embed: np.ndarray  # idf x basis, by term; the last row is zero
    passages: list[Passage]
    scales: dict[int, tuple[np.ndarray, np.ndarray]]  # by scale: passages' places, unit vectors in columns

    def _at(self, place: np.ndarray, term: np.ndarray) -> np.ndarray:
        return (place * np.int64(len(self.terms) + 1) + term) * np.int64(0x9E3779B97F4A7C1) >> 8 & (8 * len(self.cells) - 1)

    def _has(self, place: np.ndarray, term: np.ndarray) -> np.ndarray:
        at = self._at(place, term)
        return (self.cells[at >> 3] >> (at & 7).astype(np.uint8) & 1).view(bool)

    def prepare(self) -> None:
        """cells: bits of whether a passage has a term, by hash, so that the memory grows with the passages' words alone;
        an accident lets a candidate through to the check. need: how many distinct terms a leak shares at least."""
        if not hasattr(self, "cells"):
            words = [np.array(sorted(set(p.terms))) for p in self.passages]
            sizes = np.array([len(w) for w in words], np.int64)
            self.cells = np.zeros(1 << int(8 * sizes.sum() + 1).bit_length(), np.uint8)
            if len(words):
                at = self._at(np.repeat(np.arange(len(words)), sizes), np.concatenate(words))
                np.bitwise_or.at(self.cells, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            self.need = sizes - (1 - COMMON) * np.array([len(p.terms) for p in self.passages])
            self.codes = _codes(self.terms)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cells", "need", "codes")}

    def _units(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms of each unit of the texts' words and of what windows that begin in it reach beyond it, in one
        array, and where each unit's begin there."""
        none, beyond = len(self.terms), SCALES[-1] + 2 * REACH
        known = np.flatnonzero(self.ids != none)
        unit, term = known // UNIT, self.ids[known]
        also = np.flatnonzero((known % UNIT < beyond) & (unit > 0))
        key = np.sort(np.concatenate((unit, unit[also] - 1)) * np.int64(none + 1) + np.concatenate((term, term[also])))
        key = key[np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))]
        return key % (none + 1), np.searchsorted(key // (none + 1), np.arange(len(self.ids) // UNIT + 2))

    def _possible(self, first: np.ndarray, place: np.ndarray, units: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which windows lie in a unit that has as many distinct terms of the passage as a leak shares at least."""
        terms, begin = units
        pair, of = np.unique(np.maximum(first - REACH, 0) // UNIT * np.int64(len(self.passages)) + place, return_inverse=True)
        unit, passage = pair // len(self.passages), pair % len(self.passages)
        out = np.empty(len(pair), bool)
        for some in np.array_split(np.arange(len(pair)), 1 + len(pair) // 1_000):
            sizes = begin[unit[some] + 1] - begin[unit[some]]
            ends = np.cumsum(sizes)
            near = terms[np.repeat(begin[unit[some]] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
            hits = np.append(0, np.cumsum(self._has(np.repeat(passage[some], sizes), near)))
            out[some] = hits[ends] - hits[ends - sizes] >= self.need[passage[some]]
        return out[of]

    def candidates(self, texts: list[str | None], cosine: Sequence[float] = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """(windows' first words, passages' places, cosines, whether they share enough distinct terms, scale) for blocks of
        the windows and passages whose cosine is high enough; self.ids and self.starts are the texts' words."""
        self.prepare()
        self.ids, self.starts = ids, starts = _encode(texts, self.codes, BLOCK)
        if not len(ids):
            return
        ends, units = np.append(starts[1:], len(ids)), self._units()
        scales = [(scale, least) for scale, least in zip(SCALES, cosine, strict=True) if scale in self.scales]
        for begin, (scale, least) in product(range(0, len(ids), STRIP * BLOCK), scales):
            if scale == scales[0][0]:
                some = ids[begin:begin + STRIP * BLOCK + SCALES[-1] - BLOCK]
                blocks = self.embed.take(some[0::BLOCK], 0, mode="clip")
                for i in range(1, BLOCK):
                    blocks += self.embed.take(some[i::BLOCK], 0, mode="clip")
                sums = {1: blocks}
            windows = _windows(sums, scale // BLOCK)[:STRIP]
            for k in [k for k in sums if k not in KEPT[scale]]:
                del sums[k]
            places, vectors = self.scales[scale]
            norms = np.sqrt(np.einsum("ij,ij->i", windows, windows))
            bound = (least * np.where(norms > 0, norms, np.inf))[:, None]
            reach = np.arange(-REACH, scale + REACH)
            for column in range(0, len(places), COLUMNS):
                cosines = windows @ vectors[:, column:column + COLUMNS]
                cell = np.flatnonzero(cosines >= bound)
                w, p = np.divmod(cell, cosines.shape[1])
                first, place = begin + w * BLOCK, places[column + p]
                enough = self._possible(first, place, units)
                left = np.flatnonzero(enough)
                for some in np.array_split(left, 1 + len(left) // 1_000):
                    text = np.searchsorted(starts, first[some], "right") - 1
                    at = first[some, None] + reach
                    inside = (at >= starts[text, None]) & (at < ends[text, None])
                    near = np.where(inside, ids[np.clip(at, 0, len(ids) - 1)], len(self.terms))
                    hits = self._has(place[some, None], near) & (near < len(self.terms))
                    own = np.sort(np.where(hits, near, len(self.terms)), axis=1)
                    distinct = (own < len(self.terms)) & np.concatenate((np.ones((len(some), 1), bool), own[:, 1:] != own[:, :-1]), axis=1)
                    enough[some] = distinct.sum(1) >= self.need[place[some]]
                yield first, place, cosines.ravel()[cell] / norms[w], enough, scale

    def leaks(self, texts: list[str | None], first_only: bool = False) -> Iterator[tuple[int, object, float, float]]:
        """(text, item, cosine, share of a passage's words in the common subsequence), each text and item at most once: of
        the item's passages the one with the greatest share."""
        found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for first, place, cosine, enough, scale in self.candidates(texts):
            text = np.searchsorted(self.starts, first, "right") - 1
            for i in np.flatnonzero(enough).tolist():
                found.setdefault((int(text[i]), int(place[i])), []).append((float(cosine[i]), int(first[i]), scale))
        ends = np.append(self.starts[1:], len(self.ids))
        best: dict[tuple[int, object], tuple[float, float]] = {}
        told = set()
        for (text, place), windows in sorted(found.items()):
            if first_only and text in told:
                continue
            passage = self.passages[place]
            for cosine, at, scale in sorted(windows, reverse=True):
                share = common_share(passage, self.ids[max(self.starts[text], at - REACH):min(ends[text], at + scale + REACH)])
                if share >= COMMON:
                    told.add(text)
                    best[text, passage.key] = max(best.get((text, passage.key), (0.0, 0.0)), (share, cosine))
                    if first_only or share == 1.0:
                        break
        for (text, key), (share, cosine) in best.items():
            yield text, key, cosine, share


def common_share(passage: Passage, region: np.ndarray) -> float:
    """Share of the passage's words in a longest common subsequence with the region; 0 where the answer is missing."""
    n, masks = len(passage.terms), passage.masks
    hits = [t for t in region.tolist() if t in masks]
    need = COMMON * n
    if len(hits) < need or len(passage.answer & set(hits)) < ANSWER * len(passage.answer):
        return 0.0
    row = full = (1 << n) - 1  # bit-parallel: zero bits count the subsequence's length
    for t in hits:
        both = row & masks[t]
        row = ((row + both) | (row - both)) & full
    return (n - row.bit_count()) / n


def fit_search(corpus: DataFrame, rows: list[tuple], text_col: str, rank: int = RANK, seed: int = 3) -> Search:
    """rows: (key, text, answer or None) of all benchmark items; corpus: every passage of it counts."""
    words = sorted({w for _, text, answer in rows for w in tokens(text)})
    terms = {w: i for i, w in enumerate(words)}
    signs = signs_of(len(words), rank, seed)
    codes = _codes(terms)
    held: Broadcast = corpus.sparkSession.sparkContext.broadcast(codes)
    long = SCALES[-1]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_ = held.value
        signs_ = signs_of(len(codes_), rank, seed)
        seen, sums, count = np.zeros(len(codes_), np.int64), np.zeros((len(codes_), signs_.shape[1])), 0
        for batch in _pieces(batches, 0, 512):
            ids, _ = _encode([t for t in batch.column(0).to_pylist() if t], codes_, long)
            of, n, s = _sketch(ids, signs_, long)
            seen[of] += n
            sums[of] += s
            count += len(ids) // long
        of = np.flatnonzero(seen)
        width = signs_.shape[1] + 1
        values = np.concatenate((seen[of, None], sums[of].astype(np.int64)), axis=1).ravel()
        at = (of[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(values, count))], names=["at", "v"])

    got = corpus.select(F.col(text_col).cast("string")).mapInArrow(sketched, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(len(words) * (rank + 1) + 1)
    flat[got.column(0).to_numpy()] = got.column(1).to_numpy()  # the passages' number is the last
    seen, sums, count = flat[:-1].reshape(len(words), rank + 1)[:, 0], flat[:-1].reshape(len(words), rank + 1)[:, 1:].copy(), flat[-1]
    ids, _ = _encode([r[1] for r in rows], codes, long)
    if len(ids):
        of, n, s = _sketch(ids, signs, long)
        seen[of] += n
        sums[of] += s
        count += len(ids) // long
    idf = np.log((count + 1) / (seen + 1)) + 1e-3
    embed = np.append(idf[:, None] * _basis(idf, sums, signs[:-1]), np.zeros((1, rank)), axis=0).astype(np.float32)
    passages: list[Passage] = []
    at_scale: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for key, text, answer in rows:
        own = [terms[w] for w in tokens(text)]
        told = {terms[w] for w in tokens(answer) if w in terms}
        for at in range(0, max(1, len(own) - STEP) if own else 0, STEP):
            part = own[at:at + long]
            rare = sorted(set(part), key=lambda t: (-idf[t], t))
            v = embed[part].sum(0)
            if (norm := np.linalg.norm(v)) > 0:
                kept = at_scale.setdefault(next(s for s in SCALES if len(part) <= s), ([], []))
                kept[0].append(len(passages))
                kept[1].append(v / norm)
                passages.append(Passage(key, part, told or set(rare[:max(1, len(rare) // 2)])))
    return Search(terms, embed, passages, {s: (np.array(p), np.stack(v, axis=1)) for s, (p, v) in sorted(at_scale.items())})


def _rows(benchmark: DataFrame, item_col: str, text_col: str, answer_col: str | None) -> list[tuple]:
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    got = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("k"), F.col(text_col).cast("string").alias("t"), answer.alias("a")).distinct().collect()
    return sorted(((r.k, r.t, r.a) for r in got), key=lambda r: (str(r[0]), r[1], r[2] or ""))


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """doc_id, item_id, cosine and common for every document and item it leaks: of the item's passages the one of which the
    greatest share of words is there in order, and that share.

    An item of up to the longest scale's words is one passage; longer ones are judged by passages, so that a part of them
    is a leak. The answer is answer_col's if that has words of the benchmark, else the rarer half of a passage's words. The
    benchmark is a query set: searched against all documents. Null texts and items without words leak nothing; repeated
    documents each give their rows; repeated items count once, equal texts of several ids once for each. Ids are of any
    type and may be null. Columns that aren't named are ignored. Empty tables: empty result."""
    spark = documents.sparkSession
    item = benchmark.schema[item_col].dataType
    schema = f"doc_id {documents.schema[id_col].dataType.simpleString()}, item_id {item.simpleString()}, cosine double, common double"
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, kind = _rows(benchmark, item_col, item_text_col, answer_col), to_arrow_type(item)
    if not rows:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(fit_search(source, rows, "text"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, 1):
            if got := list(held.value.leaks(batch.column(1).to_pylist())):
                cols = [batch.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([g[1] for g in got], kind),
                        pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "cosine", "common"])

    return source.mapInArrow(searched, schema)


def drop_leaks(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """documents without those that leak any item; a decision by row, so that texts aren't shuffled."""
    src, width, rows = tmp("text"), len(documents.columns), _rows(benchmark, item_col, item_text_col, answer_col)
    if not rows:
        return documents
    held = documents.sparkSession.sparkContext.broadcast(fit_search(documents, rows, text_col))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, width):
            keep = np.ones(batch.num_rows, bool)
            keep[[g[0] for g in held.value.leaks(batch.column(batch.num_columns - 1).to_pylist(), first_only=True)]] = False
            yield batch.drop_columns([src]).filter(pa.array(keep))

    return documents.select("*", F.col(text_col).cast("string").alias(src)).mapInArrow(clean, documents.schema)


def op9_decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Leaks of the benchmark in all documents, as find_leaks tells them."""
    return find_leaks(documents, benchmark)
