"""Perplexity by Brown's class-based bigrams.

P(word | previous) = P(class | previous class) x P(word | class). Exchange clustering assigns every word of the training
texts to a class so that the class bigrams' likelihood is greatest: the most frequent words first, in turn, on the
driver; then rounds over all words, in which the tasks count each word's neighbours by class, the counts are dealt by word
and each word goes to the class of the greatest gain, if that is more than naming a class costs (the logarithm of their
number), so that a word seen once doesn't learn its one context by heart. A round's moves hold if the likelihood rises, else half of them do,
and so on; the rounds end when the rise per token is small. The number of classes grows with the vocabulary.

The words that the tasks hold (head) are those above a count that is chosen so that they are at most a bound. All rarer
words, and the words that no training text has, are grouped by their last bytes; a group moves as one symbol, by the
contexts of its words. Their exact counts come by a join, however large the vocabulary grows. An end of text is a class of
its own. Transitions are smoothed by the classes' own frequency. The unknown word has the class of its ending, and in a
class a count of DISCOUNT for each word seen once whose ending is of that class, at any size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import crc32_mod, durable, rows_of, text_or_empty, tmp, words_of

HEAD = 200_000  # words that each task may hold
SINGLE = 1_000  # most frequent words, clustered on the driver before the rounds over all words
LEAST_CLASSES, MOST_CLASSES = 64, 256
ENDINGS = 4_096  # groups of the words beyond the head
LAST = 3  # bytes of an ending
ROUNDS = 3  # over all words, at most
RISE = 0.003  # of the likelihood per token (natural log), below which the rounds end
DISCOUNT = 0.5
SMALL = 8  # counts of neighbours whose rises are read from a table
PRIOR = 2.0  # weight of a class's own frequency in its transitions
FLUSH = 400_000  # distinct words that a counting task holds
BINS = 8  # of counts, for each doubling


def classes_for(words: int) -> int:
    """About an eighth of the vocabulary's square root, a power of two."""
    return int(min(MOST_CLASSES, max(LEAST_CLASSES, 2 ** round(math.log2(words + 1) / 2 - 3))))


@dataclass
class Model:
    """Symbols are head words and then endings: their classes and emissions; class statistics; totals of the training tokens."""

    symbol: dict[bytes, int]  # place of a head word
    counts: np.ndarray  # of head words
    of_symbol: np.ndarray
    transition: np.ndarray  # log10 P(class | previous class)
    emission: np.ndarray  # log10 P(word | class) of a head word; of an ending what a count's log10 is added to
    endings: int
    unseen: np.ndarray  # by class: the unknown word's count
    end_class: int
    tokens: int
    words: int
    ends: int
    info: dict = field(default_factory=dict)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        return symbols_of(words, self.symbol, self.endings)


def symbols_of(words: list[bytes], symbol: dict[bytes, int], endings: int) -> np.ndarray:
    s = np.fromiter(map(symbol.get, words, repeat(-1)), np.int64, len(words))
    rare = np.flatnonzero(s < 0)
    s[rare] = [len(symbol) + crc32(words[i][-LAST:]) % endings for i in rare.tolist()]
    return s


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def _likelihood(n: np.ndarray) -> float:
    """Of class bigrams, but for a constant of the corpus."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(0)).sum() - _xlogx(n.sum(1)).sum())


def _rises(n: np.ndarray) -> list[np.ndarray]:
    """[r - 1, j, b]: the rise of x log x from n[b, j] to n[b, j] + r, for r up to SMALL; and the same of n's transpose."""
    more = np.arange(1, SMALL + 1)[:, None, None]
    return [_xlogx(m.T[None] + more) - _xlogx(m.T)[None] for m in (n, n.T)]


def _gains(n: np.ndarray, a: np.ndarray, r: np.ndarray, l: np.ndarray, own: np.ndarray, rises: list[np.ndarray] | None = None) -> np.ndarray:  # noqa: E741
    """By word and class, the likelihood if the word of class a were there, but for a constant of the word; r, l: its
    followers' and precursors' classes, a row each, without its pairs with itself (own). Only classes it meets are looked at;
    rises: those of n, for the many small counts."""
    w = np.arange(len(a))
    gain = np.zeros_like(r)
    for side, (m, x, y) in enumerate(((n, r, l), (n.T, l, r))):
        of, at = np.nonzero(x)
        if not len(of):
            continue
        more, mine = x[of, at], a[of]
        rise = np.empty((len(of), len(n)))
        read = (more <= SMALL) & (at != mine) if rises is not None else np.zeros(len(of), bool)
        e = np.flatnonzero(read)
        rise[e] = rises[side][more[e].astype(np.int64) - 1, at[e]] if len(e) else 0.0
        here = m[mine[e], at[e]]  # without the word
        rise[e, mine[e]] = _xlogx(here) - _xlogx(here - more[e])
        e = np.flatnonzero(~read)
        part = m.T[at[e]].copy()  # [entry, class]: from each class to the one that is met
        part[np.arange(len(e)), mine[e]] -= more[e]
        same = np.flatnonzero(at[e] == mine[e])
        part[same] -= y[of[e][same]]
        part[same, at[e][same]] -= own[of[e][same]]
        rise[e] = _xlogx(part + more[e, None]) - _xlogx(part)
        rise[np.arange(len(of)), at] = 0.0  # the diagonal is told below
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        gain[of[starts]] += np.add.reduceat(rise, starts, axis=0)
    both = np.tile(np.diagonal(n), (len(a), 1))
    both[w, a] -= r[w, a] + l[w, a] + own
    gain += _xlogx(both + r + l + own[:, None]) - _xlogx(both)
    for m, x in ((n.sum(1), r), (n.sum(0), l)):
        sums, more = np.tile(m, (len(a), 1)), x.sum(1) + own
        sums[w, a] -= more  # without the word; its precursors and followers stay where they are
        gain += _xlogx(sums) - _xlogx(sums + more[:, None])
    return gain


def _best(gain: np.ndarray, a: np.ndarray, open_: int, cost: float = 1e-9) -> np.ndarray:
    """The class of the greatest gain among the first open_, if it is above a's by more than cost; ties go to the lower."""
    gain = gain[:, :open_]
    best = gain.argmax(1)
    w = np.arange(len(a))
    return np.where(gain[w, best] - gain[w, a] > cost, best, a)


def exchange(pairs: np.ndarray, start: np.ndarray, open_: int, rounds: int = 6) -> np.ndarray:
    """Classes of symbols: each in turn moves to the class that raises the class bigrams' likelihood most.

    pairs[a, b]: how often b follows a. Symbols whose class is open_ or above stay, and none goes there. Sums are of whole
    numbers. It ends when no symbol moves, or after that many rounds."""
    of, classes = start.copy(), int(start.max(initial=open_ - 1)) + 1
    onehot = np.zeros((len(of), classes))
    onehot[np.arange(len(of)), of] = 1
    right, left = pairs @ onehot, pairs.T @ onehot  # by symbol: followers' and precursors' classes
    n = onehot.T @ right
    weight = pairs.sum(1) + pairs.sum(0)
    order = [s for s in np.argsort(-weight, kind="stable") if of[s] < open_ and weight[s]]
    for _ in range(rounds):
        moved = 0
        for s in order:
            a, r, l, own = of[s], right[s].copy(), left[s].copy(), pairs[s, s]
            r[a] -= own
            l[a] -= own
            one = of[s:s + 1]
            b = int(_best(_gains(n, one, r[None], l[None], pairs[s, s:s + 1]), one, open_)[0])
            if b != a:
                for at, sign in ((a, -1), (b, 1)):
                    n[at] += sign * r
                    n[:, at] += sign * l
                    n[at, at] += sign * own
                of[s] = b
                moved += 1
                right[:, a] -= pairs[:, s]
                right[:, b] += pairs[:, s]
                left[:, a] -= pairs[s]
                left[:, b] += pairs[s]
        if not moved:
            break
    return of


def count_words(texts: DataFrame) -> DataFrame:
    """word (binary) and n over texts (one binary column); a task sends its counts whenever it holds FLUSH words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in rows_of(batches, 128):
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
            if len(seen) >= FLUSH:
                yield send()
                seen.clear()
        yield send()

    return texts.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _encoded(texts: DataFrame, symbol: dict[bytes, int], endings: int) -> DataFrame:
    """The texts as symbols, written once: an end, then each text's words and an end; some texts a row."""
    held, end = texts.sparkSession.sparkContext.broadcast(symbol), len(symbol) + endings

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 64):
            parts = [np.array([end])]
            for text in batch.column(0).to_pylist():
                parts += [symbols_of(words_of(text), held.value, endings), parts[0]]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).astype(np.int32).tobytes()], pa.binary())], names=["ids"])

    return durable(texts.mapInArrow(encoded, "ids binary"))


def _bigrams(ids: DataFrame, of: np.ndarray) -> np.ndarray:
    """How often each class follows each, over all texts; of: the symbols' classes, the end last."""
    classes = int(of.max()) + 1
    held = ids.sparkSession.sparkContext.broadcast(of.astype(np.int32))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, parts, size = np.zeros(classes * classes, np.int64), [], 0
        for batch in batches:
            for raw in batch.column(0):
                c = held.value[np.frombuffer(raw.as_buffer(), np.int32)]
                parts.append(c[:-1] * np.int64(classes) + c[1:])
                size += len(c)
                if size > 1 << 20:
                    sums += np.bincount(np.concatenate(parts), minlength=len(sums))
                    parts, size = [], 0
        if parts:
            sums += np.bincount(np.concatenate(parts), minlength=len(sums))
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["pair", "n"])

    got = ids.mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(classes, classes)


def _placed(ids: DataFrame, of: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Each symbol's class of the greatest gain, all others staying, where it is worth the cost of naming a class. The end
    (the last symbol and class) takes no words. A symbol's neighbours are counted in the tasks and dealt by symbol: at most
    twice the classes and one numbers for each."""
    classes, end = len(follow), len(of) - 1
    slots = 2 * classes + 1  # followers by class, precursors by class, the symbol itself
    held = ids.sparkSession.sparkContext.broadcast((of.astype(np.int32), follow))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_ = held.value[0]
        keys, ns, parts, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            fresh, n = np.unique(np.concatenate(parts), return_counts=True)
            both, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([ns, n]), len(both)).astype(np.int64)

        def send() -> pa.RecordBatch:
            """A row a symbol: the slots of its neighbours and their numbers."""
            word = keys // slots
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.empty(0, np.int64)
            offsets = pa.array(np.append(starts, len(word)).astype(np.int32))
            listed = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((keys % slots).astype(np.int16), ns.astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(word[starts].astype(np.int32)), *listed], names=["word", "slot", "n"])

        for batch in batches:
            for raw in batch.column(0):
                s = np.frombuffer(raw.as_buffer(), np.int32)
                c, wide = of_[s], s.astype(np.int64) * slots
                same = s[1:] == s[:-1]
                after, before = np.where(same, 2 * classes, c[1:]), c[:-1] + classes
                parts.append((wide[:-1] + after)[s[:-1] != end])
                parts.append((wide[1:] + before)[~same & (s[1:] != end)])  # a pair of the symbol with itself counts once
                size += len(s)
                if size > 1 << 21:
                    keys, ns = summed()
                    parts, size = [], 0
                    if len(keys) > FLUSH * 10:
                        yield send()
                        keys, ns = np.empty(0, np.int64), np.empty(0, np.int64)
        if parts:
            keys, ns = summed()
        yield send()

    def best(keys: np.ndarray, ns: np.ndarray) -> pa.RecordBatch:
        """keys: symbol x slots + slot, in order, for whole symbols."""
        of_, n = held.value
        word = keys // slots
        starts = np.append(np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))), len(word)) if len(word) else np.zeros(1, np.int64)
        words, at = word[starts[:-1]], 0
        out = np.empty(len(words), np.int32)
        if not tables:
            tables.extend(_rises(n))
        while at < len(words):  # as many symbols as have some thousand neighbours
            upto = max(at + 1, int(np.searchsorted(starts, starts[at] + 4_096, "right")) - 1)
            v = np.zeros((upto - at, slots))
            v[np.repeat(np.arange(upto - at), np.diff(starts[at:upto + 1])), keys[starts[at]:starts[upto]] % slots] = ns[starts[at]:starts[upto]]
            a = of_[words[at:upto]].astype(np.int64)
            out[at:upto] = _best(_gains(n, a, v[:, :classes], v[:, classes:-1], v[:, -1], tables), a, classes - 1, cost)
            at = upto
        return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(out)], names=["word", "class"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by symbol; the last one of a batch may go on in the next. What is held is a batch and one symbol."""
        keys, ns = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, n = batch.column(1), batch.column(2)
            sizes = np.diff(slot.offsets.to_numpy())
            fresh = np.repeat(batch.column(0).to_numpy().astype(np.int64), sizes) * slots + slot.flatten().to_numpy()
            keys, at = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            ns = np.bincount(at, np.concatenate([ns, n.flatten().to_numpy()]), len(keys)).astype(np.int64)
            whole = int(np.searchsorted(keys, keys[-1] // slots * slots))
            if whole:
                yield best(keys[:whole], ns[:whole])
                keys, ns = keys[whole:], ns[whole:]
        yield best(keys, ns)

    cost, tables = math.log(classes), []  # the tables are made in each task
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes make much work here
    near = ids.mapInArrow(counted, "word int, slot array<short>, n array<int>").repartition(parts, "word").sortWithinPartitions("word")
    got = near.mapInArrow(chosen, "word int, class int").toArrow()
    out = of.copy()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _clustered(ids: DataFrame, of: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes after rounds over all symbols, their bigrams, and the likelihood per token of each round."""
    follow = _bigrams(ids, of)
    tokens, found = max(1.0, follow.sum()), [_likelihood(follow) / max(1.0, follow.sum())]
    turn = np.random.default_rng(len(of)).random(len(of))
    for _ in range(rounds):
        better, share = _placed(ids, of, follow), 1.0
        while share >= 0.1:
            some = np.where(turn < share, better, of)
            after = _bigrams(ids, some)
            if (now := _likelihood(after) / tokens) > found[-1]:
                break
            share /= 2
        else:
            break
        of, follow = some, after
        found.append(now)
        if found[-1] - found[-2] < RISE:
            break
        turn = (turn + 0.5) % 1.0
    return of, follow, found


def _sized(counts: DataFrame, head: int) -> tuple[int, int, int]:
    """Words, their tokens, and the least count of head words: of the bins of counts the longest run from the top that
    has at most head words. Bins are a BINS-th of a doubling, so each count below BINS is a bin of its own."""
    bins = counts.groupBy(F.floor(F.log2("n") * BINS + 1e-9).alias("b")).agg(F.count("*").alias("c"), F.sum("n").alias("t"), F.min("n").alias("least"))
    rows = sorted(((r.b, r.c, r.t, r.least) for r in bins.collect()), reverse=True)
    held, least = 0, 2 ** (max((r[0] for r in rows), default=0) // BINS + 1) + 1  # above all counts
    for _, c, _, low in rows:
        if held + c > head:
            break
        held, least = held + c, low
    return sum(r[1] for r in rows), sum(r[2] for r in rows), least


def fit(texts: DataFrame, counts: DataFrame, head: int = HEAD, single: int = SINGLE, classes: int | None = None,
        endings: int = ENDINGS, rounds: int = ROUNDS) -> Model:
    """A model of texts (one binary column, no nulls) whose words' counts are in counts (word, n)."""
    ends = texts.count()
    words, tokens, least = _sized(counts, head)
    classes = classes or classes_for(words)
    got = counts.where(F.col("n") >= least).toArrow()
    listed = sorted(zip(got.column(1).to_pylist(), got.column(0).to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    n = np.array([x[0] for x in listed], np.int64)
    symbol = {w: i for i, (_, w) in enumerate(listed)}
    once, tail = np.zeros(endings), np.zeros(endings)
    ending = F.pmod(F.crc32(F.substring("word", -LAST, LAST)), F.lit(endings))
    for r in counts.groupBy(ending.alias("e")).agg(F.count_if(F.col("n") == 1).alias("once"), F.sum(F.when(F.col("n") < least, F.col("n")).otherwise(0)).alias("tail")).collect():
        once[r.e], tail[r.e] = r.once, r.tail
    unseen = DISCOUNT * (once + 1 / endings)
    ids = _encoded(texts, symbol, endings)
    # the most frequent words singly, the others in bands by their count, endings in the lowest
    band = np.concatenate([np.log2(np.maximum(n, 1)).astype(np.int64), np.zeros(endings, np.int64)])
    place = np.arange(len(n) + endings)
    coarse = np.append(np.where(place < min(single, len(n)), place, min(single, len(n)) + band), min(single, len(n)) + 64)
    pairs = _bigrams(ids, coarse)
    start = np.arange(len(pairs)) % classes
    start[-1] = classes
    of = exchange(pairs, start, classes)[coarse]
    of, follow, rise = _clustered(ids, of, rounds if len(n) > single or tail.any() else 0)
    # an ending that no training text has beyond the head goes where the rarest held words of it are
    votes = np.zeros((endings, classes))
    np.add.at(votes, (np.array([crc32(w[-LAST:]) % endings for _, w in listed], np.int64), of[:len(n)]), 1 / n)
    of_ending = np.where(votes.any(1), votes.argmax(1), votes.sum(0).argmax())
    of[len(n):-1] = np.where(tail > 0, of[len(n):-1], of_ending)
    mass = np.bincount(of[len(n):-1], unseen, classes + 1)
    before = follow.sum(1)
    follow = follow + np.outer(before / max(1.0, before.sum()), mass)
    own = (follow.sum(0) + 0.5) / (follow.sum() + 0.5 * (classes + 1))
    transition = np.log10((follow + PRIOR * own) / (follow.sum(1, keepdims=True) + PRIOR))
    sizes = np.bincount(of[:-1], np.concatenate([n, tail + unseen]), classes + 1)
    emission = np.log10(np.concatenate([n, np.ones(endings)]) / sizes[of[:-1]])
    return Model(symbol, n, of[:-1], transition, emission, endings, mass, classes, tokens + ends, words + (ends > 0), ends,
                 {"least": least, "likelihood": rise, "classes": classes})


def score_texts(df: DataFrame, model: Model, counts: DataFrame, text_col: str = "text") -> DataFrame:
    """df without its text, with n_tokens, n_known, train_tokens, base_score and score.

    base_score: the unigrams' log10 probability with one added to each count; score: the class model's. A text's tokens
    are its words and one end. Null text: empty. Repeated rows and ids: each row is scored alone. Empty tables stay empty;
    columns of df of these names are replaced."""
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    own = [c for c in df.columns if c not in (*made, text_col)]
    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.select(*own).schema)
    held = df.sparkSession.sparkContext.broadcast(model)
    unit = math.log10(model.tokens + model.words + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        first = len(m.counts)
        base, unseen = np.append(np.log10(m.counts + 1.0), np.zeros(m.endings)), np.log10(np.maximum(m.unseen, 1e-300))
        for batch in rows_of(batches):
            cols: list[list] = [[] for _ in range(5)]
            for text in batch.column(batch.num_columns - 1).to_pylist():
                w = words_of(text)
                s = m.symbols(w)
                c = np.full(len(w) + 2, m.end_class, np.int64)
                c[1:-1] = m.of_symbol[s]
                rare = Counter((w[i], int(m.of_symbol[s[i]])) for i in np.flatnonzero(s >= first).tolist())
                values = (len(w) + 1, len(w) - sum(rare.values()) + (m.ends > 0), float(base[s].sum()) + math.log10(m.ends + 1),
                          float(m.emission[s].sum() + m.transition[c[:-1], c[1:]].sum()), [{"word": x, "n": n, "unseen": unseen[c_]} for (x, c_), n in rare.items()])
                for col, v in zip(cols, values, strict=True):
                    col.append(v)
            tail = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32()), ("unseen", pa.float64())]))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), tail]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=[*own, "n_tokens", "head_known", "head_base", "head_score", "tail"])

    rid = tmp("row")
    heads = durable(df.select(*own, text_or_empty(F.col(text_col)).cast("binary").alias(tmp("text")))
                    .mapInArrow(scored, f"{fields}n_tokens long, head_known long, head_base double, head_score double, tail array<struct<word:binary,n:int,unseen:double>>")
                    .withColumn(rid, F.monotonically_increasing_id()))
    n, c = F.col("t.n"), F.coalesce(F.col("c"), F.lit(0))
    emitted = F.when(c > 0, F.log10(c)).otherwise(F.col("t.unseen"))
    tails = (heads.select(rid, F.explode("tail").alias("t"))
             .join(counts.where(F.col("n") < model.info["least"]).select(F.col("word").alias("w"), F.col("n").alias("c")), F.col("t.word") == F.col("w"), "left")
             .groupBy(rid).agg(F.sum(F.when(c > 0, n).otherwise(0)).alias("known"), F.sum(n * F.log10(c + 1)).alias("base"), F.sum(n * emitted).alias("emitted")))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return heads.drop("tail").join(tails, rid, "left").select(
        *own, "n_tokens", (F.col("head_known") + zero("known")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("base") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("head_score") + zero("emitted")).alias("score"))


def class_lm(df: DataFrame, train: Column, text_col: str = "text", head: int = HEAD) -> DataFrame:
    """score_texts of all of df under a model of the rows for which train holds."""
    texts = df.where(train).select(text_or_empty(F.col(text_col)).cast("binary").alias("text"))
    counts = durable(count_words(texts))
    return score_texts(df, fit(texts, counts, head), counts, text_col)


def op6_class_lm(documents: DataFrame) -> DataFrame:
    """The contract's result over all documents."""
    held_out = crc32_mod("doc_id", 7) == 2
    rows = documents.select("doc_id", held_out.alias("held_out"), "text")
    return class_lm(rows, ~F.col("held_out"))
