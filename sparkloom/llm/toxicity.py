"""Toxicity by a logistic classifier that is held to equal scores for counterfactual texts.

Features are a text's distinct words and the 5-letter beginnings of its longer words, by 32-bit hash. In a labelled text
that names an identity, each such term is swapped for the next of its group; a labelled text that names none is given one
term of a group, and once another of it, by its hash. Training adds a penalty on the squared difference of the two texts'
logits, so that a neutral mention of a group moves no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import crc32_mod, rows_of, tmp

#: Terms that may take each other's place in a sentence, by group, in English, French, German and Spanish.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("woman", "man"), ("women", "men"), ("female", "male"), ("girl", "boy"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("deaf", "blind", "disabled"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("femme", "homme"), ("femmes", "hommes"), ("immigré", "réfugié", "étranger", "citoyen"), ("sourd", "aveugle", "handicapé"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("frau", "mann"), ("frauen", "männer"), ("einwanderer", "flüchtling", "ausländer", "bürger"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("inmigrante", "refugiado", "extranjero", "ciudadano"),
)
TOKEN = re.compile(r"[^\W_]+")
STEM = 5
SAMPLE = 20_000


def swaps(groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[dict[str, str]]:
    """For each distance around the groups what takes a term's place; terms that come back to themselves are left out."""
    longest = max(map(len, groups), default=0)
    return [{t: g[(i + k) % len(g)] for g in groups for i, t in enumerate(g) if k % len(g)} for k in range(1, longest)]


def counterparts(words: set[str], turns: list[dict[str, str]], groups: Sequence[Sequence[str]]) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets that should score alike: a text and each of its swaps, or where it names no group, it with a
    mention and with another of the same group."""
    if pairs := [(words, {t.get(w, w) for w in words}) for t in turns if words & t.keys()]:
        return pairs
    some = [g for g in groups if len(g) > 1]
    if not some or not words:
        return []
    h = crc32(" ".join(sorted(words)).encode("utf-8", "surrogatepass"))
    g = some[h % len(some)]
    i = h // len(some) % len(g)
    return [(words | {g[i]}, words | {g[(i + 1) % len(g)]})]


def features(words: set[str]) -> np.ndarray:
    """Hashes of the words and of the longer words' beginnings, distinct."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    stems = {b"^" + w[:STEM].encode("utf-8", "surrogatepass") for w in words if len(w) > STEM}
    found = np.fromiter((crc32(x) for y in (raw, stems) for x in y), np.uint32, len(raw) + len(stems))
    return np.unique(found)


def words_in(text: str | None) -> set[str]:
    return set(TOKEN.findall((text or "").lower()))


@dataclass
class Model:
    """Weights by feature; features without evidence have none."""

    keys: np.ndarray  # sorted uint32
    weights: np.ndarray
    bias: float

    def table(self) -> dict[int, float]:
        strong = np.abs(self.weights) > 1e-4
        return dict(zip(self.keys[strong].tolist(), self.weights[strong].tolist(), strict=True))


def score_words(words: set[str], table: dict[int, float], bias: float) -> float:
    get = table.get
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    stems = {b"^" + w[:STEM].encode("utf-8", "surrogatepass") for w in words if len(w) > STEM}
    z = bias + sum(map(get, {*map(crc32, raw), *map(crc32, stems)}, repeat(0.0)))
    return 1 / (1 + np.exp(-z)) if z > -700 else 0.0


class _Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[np.ndarray], keys: np.ndarray):
        known = [np.searchsorted(keys, r) for r in rows]
        known = [at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == r)] if len(keys) else at[:0] for at, r in zip(known, rows, strict=True)]
        self.n, self.width = len(rows), len(keys)
        self.of = np.repeat(np.arange(self.n), [len(k) for k in known])
        self.at = np.concatenate(known).astype(np.int32) if known else np.empty(0, np.int32)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.at], self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, v[self.of], self.width)


def minimise(fun, x: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; fun gives the value and its gradient."""
    f, g = fun(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ d))
            d = d - alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, rho), a in zip(past, reversed(alphas), strict=True):
            d = d + s * (a - rho * (y @ d))
        step, slope = 1.0 if past else 1 / max(1.0, np.linalg.norm(g)), g @ d
        for _ in range(20):
            f2, g2 = fun(x + step * d)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, g2 - g
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        x, f, g = x + s, f2, g2
        if done:
            break
    return x


def evidence(n: np.ndarray, k: np.ndarray, rate: float) -> np.ndarray:
    """Twice the log-likelihood ratio of k of n labels 1 against the overall rate."""
    log = lambda x, y: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(y, 1e-12)), 0.0)
    return 2 * (log(k, n * rate) + log(n - k, n * (1 - rate)))


def fit(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]],
        least: float = 18.0, l2: float = 0.05, fairness: float = 1.0) -> Model:
    """Logistic loss + l2 |w|^2 / 2 + fairness x squared logit differences of the pairs (features of a text, of its swap).

    Only features whose evidence against the overall rate is at least least take part, and those that a swap changes:
    words seen a few times would else learn the labels by heart."""
    n = len(rows)
    if not n:
        return Model(np.empty(0, np.uint32), np.empty(0), 0.0)
    y = labels.astype(float)
    rate = (y.sum() + 0.5) / (n + 1)
    found, counts = np.unique(np.concatenate(rows), return_counts=True)
    ones = np.zeros(len(found))
    if y.any():
        seen, times = np.unique(np.concatenate([r for r, one in zip(rows, y, strict=True) if one]), return_counts=True)
        ones[np.searchsorted(found, seen)] = times
    held = [np.setxor1d(a, b) for a, b in pairs]
    keys = np.union1d(found[evidence(counts, ones, rate) >= least], np.concatenate(held) if held else np.empty(0, np.uint32)).astype(np.uint32)
    x, a, b = _Rows(rows, keys), _Rows([p[0] for p in pairs], keys), _Rows([p[1] for p in pairs], keys)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, bias = p[:-1], p[-1]
        z = x.dot(w) + bias
        off = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
        gap = a.dot(w) - b.dot(w) if pairs else np.empty(0)
        value = np.logaddexp(0, z).sum() - (y * z).sum() + l2 / 2 * (w @ w) + fairness * (gap @ gap)
        grad = x.back(off) + l2 * w
        if pairs:
            grad = grad + 2 * fairness * (a.back(gap) - b.back(gap))
        return float(value), np.append(grad, off.sum())

    p = minimise(loss, np.append(np.zeros(len(keys)), np.log(rate / (1 - rate))))
    return Model(keys, p[:-1], float(p[-1]))


def fit_toxicity(documents: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id",
                 groups: Sequence[Sequence[str]] = IDENTITY_TERMS, sample: int = SAMPLE) -> Model:
    """A model of at most sample labelled documents, those of the least hash of the id: the documented bound on what is
    broadcast (ids and labels) and on what the driver holds (hashes of words). Null ids, labels and texts are left out;
    of an id's several labels the greatest counts, of its several texts the least features, so that repeated rows and the
    order of rows change nothing. Other columns are ignored."""
    turns = swaps(groups)
    label = F.col(label_col).cast("int")
    known = labels.where(label.isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("label"))
    few = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            own, other = [], []
            for text in batch.column(2).to_pylist():
                words = words_in(text)
                own.append(features(words).tobytes())
                other.append([features(x).tobytes() for pair in counterparts(words, turns, groups) for x in pair])  # two by two
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.binary()), pa.array(other, pa.list_(pa.binary()))], names=["id", "label", "own", "other"])

    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = documents.schema[id_col].dataType.simpleString()
    got = (texts.join(few, "id").select("id", "label", "t").mapInArrow(featured, f"id {kind}, label int, own binary, other array<binary>")
           .groupBy("id", "label").agg(F.min(F.struct("own", "other")).alias("f")).select("id", "label", "f.own", "f.other").toArrow())
    order = np.argsort(got.column(0).to_numpy(), kind="stable")  # sums in the same order in any run
    own, other = (c.take(pa.array(order)).to_pylist() for c in (got.column(2), got.column(3)))
    own = [np.frombuffer(x, np.uint32) for x in own]
    read = lambda x: np.frombuffer(x, np.uint32)
    pairs = [(read(x[i]), read(x[i + 1])) for x in other for i in range(0, len(x), 2)]
    return fit(own, got.column(1).to_numpy()[order], pairs)


def score_toxicity(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df without its text, with score (0 to 1) and predicted (1 if score >= 0.5).

    Only the text is an input, and whole: its distinct words, however long it is. Null and empty texts get the score of no
    words; equal texts equal scores. Empty tables stay empty; columns of df named score or predicted are replaced."""
    own = [c for c in df.columns if c not in ("score", "predicted", text_col)]
    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.select(*own).schema)
    table, bias = df.sparkSession.sparkContext.broadcast(model.table()), model.bias

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = table.value
        for batch in rows_of(batches):
            s = np.array([score_words(words_in(t), weights, bias) for t in batch.column(batch.num_columns - 1).to_pylist()], float)
            cols = [*batch.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*own, "score", "predicted"])

    return df.select(*own, F.col(text_col).cast("string").alias(tmp("text"))).mapInArrow(scored, f"{fields}score double, predicted int")


def score_gaps(df: DataFrame, model: Model, text_col: str = "text", groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> DataFrame:
    """One row over the texts of df that name a group: texts, their swaps (pairs), and the mean and greatest difference of
    a swap's score from its text's (null where there is none)."""
    turns = swaps(groups)
    table, bias = df.sparkSession.sparkContext.broadcast(model.table()), model.bias

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            pairs, most, total = [], [], []
            for text in batch.column(0).to_pylist():
                words = words_in(text)
                off = [abs(score_words(words, table.value, bias) - score_words({t.get(w, w) for w in words}, table.value, bias)) for t in turns if words & t.keys()]
                if off:
                    pairs.append(len(off))
                    most.append(float(max(off)))
                    total.append(float(sum(off)))
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(most, pa.float64()), pa.array(total, pa.float64())], names=["pairs", "most", "total"])

    each = df.select(F.col(text_col).cast("string")).mapInArrow(gaps, "pairs long, most double, total double")
    return each.agg(F.count("*").alias("texts"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.try_divide(F.sum("total"), F.sum("pairs")).alias("mean_gap"), F.max("most").alias("greatest_gap"))


def op2_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's result: a model of labelled rows that aren't held out, applied to all documents. Null ids, labels and
    texts, repeated rows and empty tables as in fit_toxicity and score_toxicity."""
    held_out = crc32_mod("doc_id", 5) == 0
    model = fit_toxicity(documents, labels.where(~held_out))
    return score_toxicity(documents.select("doc_id", held_out.alias("held_out"), "text"), model)
