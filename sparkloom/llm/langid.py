"""Language identification by hyperdimensional profiles.

A letter is a fixed random vector of +1 and -1; a trigram binds its letters' vectors, rotated by their places, by
multiplication; a text bundles (adds) its trigrams' vectors; a language's prototype bundles all its training texts, each
scaled to the same length.
A text gets the language whose prototype, after removal of what all languages share, is nearest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import crc32_mod, rows_of, tmp

DIM = 1024
SEED = 20_011
UNKNOWN = "und"
KEEP = 3 / DIM**0.5  # three standard deviations of the cosine of unrelated texts
EVIDENCE = 20  # distinct trigrams of a text that may be rejected
SPACE = 32
TABLE = 2**21  # trigrams of alphabets up to its cube root are counted in a table, if the text is long enough for that
CACHED = 32_768  # trigram vectors that a worker keeps

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


class Encoder:
    """Trigrams and their vectors; what it keeps is bounded."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.ids = np.full(0x110000, -1, np.int32)  # code point -> place in an alphabet that grows as letters come
        self.points: list[int] = []
        self.vectors: dict[int, np.ndarray] = {}
        self.cache = np.empty((CACHED, dim), np.int8)
        self.place: dict[int, int] = {}

    def letter(self, point: int) -> np.ndarray:
        if point not in self.vectors:
            if len(self.vectors) >= 20_000:
                self.vectors.clear()
            bits = np.random.default_rng([self.seed, point]).integers(0, 2, self.dim, np.int8)
            self.vectors[point] = bits * 2 - 1
        return self.vectors[point]

    def gram(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of trigram codes, a row each."""
        rows = np.empty(len(codes), np.int64)
        extra: list[np.ndarray] = []
        for i, code in enumerate(codes.tolist()):
            at = self.place.get(code)
            if at is None:
                if len(self.place) < CACHED:
                    at = self.place[code] = len(self.place)
                    self.cache[at] = self.gram(code)
                else:
                    extra.append(self.gram(code))
                    at = -len(extra)
            rows[i] = at
        if not extra:
            return self.cache[rows]
        out = self.cache[np.maximum(rows, 0)]
        out[rows < 0] = extra  # in order of appearance, as are their places
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray, dtype=np.float32) -> np.ndarray:
        out = np.zeros(self.dim, dtype)
        for at in range(0, len(codes), 4096):
            out += counts[at:at + 4096].astype(dtype) @ self.grams(codes[at:at + 4096]).astype(dtype)
        return out

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigram codes and their counts. Letters are lower-cased, all else is one space."""
        points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(letter_table()[points], points, np.uint32(SPACE))
        blank = points == SPACE
        points = points[~(blank & np.concatenate(([False], blank[:-1])))] if len(points) else points
        if len(points) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ids = self.ids[points]
        if (ids < 0).any():
            for p in np.unique(points[ids < 0]).tolist():
                self.ids[p] = len(self.points)
                self.points.append(p)
            ids = self.ids[points]
        k = len(self.points)
        if k**3 <= TABLE:
            flat = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
            if k**3 <= 16 * len(flat):
                table = np.bincount(flat)
                found = np.flatnonzero(table)
                counts = table[found]
            else:
                found, counts = np.unique(flat, return_counts=True)
            of = np.array(self.points, np.int64)
            a, b, c = of[found // k**2], of[found // k % k], of[found % k]
        else:
            p = points.astype(np.int64)
            codes, counts = np.unique(p[:-2] << 42 | p[1:-1] << 21 | p[2:], return_counts=True)
            a, b, c = codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF
        whole = b != SPACE  # a trigram lies within a word and its bounds
        return (a << 42 | b << 21 | c)[whole], counts[whole]


_encoders: dict[tuple[int, int], Encoder] = {}


def encoder(dim: int, seed: int) -> Encoder:
    if (dim, seed) not in _encoders:
        _encoders[dim, seed] = Encoder(dim, seed)
    return _encoders[dim, seed]


@dataclass
class Profiles:
    """Languages by code point, and their prototypes: unit length, a row each."""

    langs: list[str]
    prototypes: np.ndarray
    dim: int = DIM
    seed: int = SEED

    def nearest(self, code_counts: tuple[np.ndarray, np.ndarray]) -> tuple[str, float]:
        codes, counts = code_counts
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        v = encoder(self.dim, self.seed).bundle(codes, counts)
        if not (norm := float(np.linalg.norm(v))):
            return UNKNOWN, 0.0
        plain = self.prototypes @ (v / norm)
        shared = self.prototypes.mean(0) if len(self.langs) > 1 else np.zeros(self.dim)
        own = self.prototypes - shared
        rest = v / norm - shared
        sizes = np.linalg.norm(own, axis=1) * (np.linalg.norm(rest) or 1.0)
        best = int(np.argmax((own @ rest) / np.where(sizes > 0, sizes, 1.0)))
        return self.langs[best], float(min(1.0, max(0.0, plain[best])))


def fit_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = SEED) -> Profiles:
    """Prototypes of all rows that have a text and a language. Sums of integers: the same for any partitioning.

    A task keeps trigram counts by language and sends one vector of each; the driver gets languages x dim numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(dim, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in rows_of(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                codes, counts = zip(*(enc.count(t) for t in texts), strict=True)
                # every text weighs the same, however long, in whole numbers
                weights = [np.rint(c * (4096 / np.sqrt((c.astype(float) ** 2).sum() or 1.0))) for c in counts]
                distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
                total = enc.bundle(distinct, np.bincount(at, np.concatenate(weights), len(distinct)), np.float64)
                sums[lang] = sums.get(lang, 0) + total.astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dim, "d": np.arange(dim, dtype=np.int32), "v": v})

    rows = (df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
            .mapInArrow(partial, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v")).collect())
    langs = sorted({r[0] for r in rows})
    sums = np.zeros((len(langs), dim))
    at = {x: i for i, x in enumerate(langs)}
    for lang, d, v in rows:
        sums[at[lang], d] = v
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return Profiles(langs, sums / np.where(norms > 0, norms, 1.0), dim, seed)


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text", keep: float | None = None, evidence: int = EVIDENCE) -> DataFrame:
    """df with lang_pred and score (cosine to the chosen language's prototype, 0 to 1).

    Null text, or one without a letter: und, 0. Of languages equally near the first by code point is chosen. With keep,
    rows that are und go, and those that have evidence or more distinct trigrams and still score below keep: a text of
    fewer tells too little to be rejected. Repeated rows get equal results; texts are read whole. Empty tables stay empty;
    columns of df named lang_pred or score are replaced."""
    own = [c for c in df.columns if c not in ("lang_pred", "score")]
    src, schema = tmp("text"), df.select(*own).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(profiles.dim, profiles.seed)
        for batch in rows_of(batches):
            counts = [enc.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            got = [profiles.nearest(c) for c in counts]
            cols = [*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            out = pa.RecordBatch.from_arrays(cols, names=[*own, "lang_pred", "score"])
            if keep is not None:
                out = out.filter(pa.array([g[0] != UNKNOWN and (g[1] >= keep or len(c[0]) < evidence) for g, c in zip(got, counts, strict=True)], pa.bool_()))
            yield out

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    return df.select(*own, F.col(text_col).cast("string").alias(src)).mapInArrow(predict, f"{fields}, lang_pred string, score double")


def op10_language_id(documents: DataFrame) -> DataFrame:
    """The contract's result: profiles of the documents that aren't held out, applied to all. Null, empty and very long
    texts, ties, repeated rows and empty tables as in identify."""
    held_out = crc32_mod("doc_id", 5) == 0
    profiles = fit_profiles(documents.where(~held_out))
    return identify(documents.select("doc_id", held_out.alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
