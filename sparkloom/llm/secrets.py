"""Secret scans: three patterns, and a battery of randomness tests for tokens that no pattern knows.

A candidate is a run of 20 or more of [A-Za-z0-9+/_-] with a digit or a letter, outside the patterns' spans, and each piece
of 20 or more between its / - _, as a key may stand in a path; run and pieces are tested and reported each. Its encoding is
the smallest alphabet that holds it. Three tests measure how far its symbols are from uniform and independent ones:
chi-squared uniformity over the alphabet (in equal cells of 5 or more expected symbols), runs above and below the middle,
and the serial correlation of neighbours; Fisher's sum of them is the token's score, and only its rank counts.

The null is ordinary text: the words and numbers of all texts outside candidates and patterns, written together as names of
each encoding are (as thisIsOne2Name, this-is-one, THIS_IS_ONE), in windows of each length class, beside a fixed reference. A candidate's p-value is the share of the
null's windows of its stratum (encoding and length class) that look as random as it does. Benjamini-Hochberg in each
stratum over the whole corpus reports candidates so that at most the rate q of those reported is ordinary text, at any
length; and none is reported that the battery itself rejects as random. A class's windows have its least length; longer ordinary tokens look less random still, so that errs on the safe
side.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import cycle, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import durable, rows_of, tmp

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as the runs of 24 and more among [0-9a-f]+
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
PIECE = re.compile(r"[A-Za-z0-9+]{20,}")
WORDS = re.compile(rb"[A-Za-z]+")
NUMERALS = re.compile(rb"[0-9]+")
KINDS = ("assign", "access", "hex", "random")
ENCODINGS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "small": "abcdefghijklmnopqrstuvwxyz",
    "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: A symbol's value is its place by class (small letters, capitals, digits, others) and in this order, so that what words
#: are made of shares cells and the tests tell words from random symbols even at 20 characters.
ORDER = "etaoinsrhldcumfpgwybvkxjqz"
_rank = lambda ch: (ch.isupper() + 2 * ch.isdigit() + 3 * (not ch.isalnum()), ORDER.find(ch.lower()), ch)
PLACES = {
    name: {ch: i for i, ch in enumerate(sorted(letters, key=_rank))}
    for name, letters in ENCODINGS.items()
}
REJECTED = 150  # the bin of a score of 0.001: one random token in a thousand looks less random, and none such is reported
P_BINS = 600  # of -log10(score), a fiftieth each
CLASSES = (20, 32, 64, 128)  # least lengths
#: Encodings in which ordinary words are written, each of which gets a part of every batch's words; runs of digits serve the
#: other three.
TEXTUAL = ("small", "capitals", "letters", "base32", "lower", "upper", "base62", "base64", "base64url")
NUMERIC = ("digits", "hex", "HEX")
NUMBERS = (b"2", b"42", b"7", b"2024", b"3", b"64", b"256", b"5", b"17")  # after every second word, where an encoding has digits
REFERENCE_WINDOWS = 1_000  # of each stratum
#: Ordinary words, for corpora that have little text outside their tokens.
REFERENCE = (
    "account after again application archive before between block buffer cache change check class client column common "
    "config connection content control count create current data default delete detail device document download error "
    "event example export field file filter first folder format function general group handle header help history home "
    "image import index info input install interface internal item last layout library license line list local login "
    "main manager master message method model module name network node notice number object option order output owner "
    "package page parent path payment person point policy process product profile program project public query queue "
    "read record release remote report request reset resource response result return role root rule sample schema "
    "search section select sender server service session setting shared simple source start state status storage store "
    "stream string system table target task team template test text thread time title total transfer type update upload "
    "user value version view window worker write year 1 2 3 7 10 12 24 64 100 128 256 404 1024 1999 2008 2017 2024"
)
SPAN = "struct<start:int,kind:int,end:int>"


def chi2_sf(x: float, df: int) -> float:
    """P(chi-squared of df > x), by the regularised upper incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-14:
                break
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for n in range(1, 10_000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return min(1.0, scale * h)


@lru_cache(maxsize=None)
def _table(df: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.linspace(0, 1, 1_000) ** 2 * 1_400
    return x, np.array([math.log(max(chi2_sf(v, df), 1e-300)) for v in x.tolist()])


def _log_sf(x: np.ndarray, df: int) -> np.ndarray:
    """log P(chi-squared of df > x), by a table."""
    return np.interp(x, *_table(df))


def encoding(token: str) -> str | None:
    """The smallest alphabet that has all of the token's characters."""
    letters = set(token)
    return next((name for name, places in PLACES.items() if letters <= places.keys()), None)


def battery(v: np.ndarray, k: int) -> np.ndarray:
    """log10 of Fisher's joint p-value of the three tests, for rows of symbols' places in an alphabet of k."""
    m, n = v.shape
    cells = max(2, min(k, n // 5))
    seen = np.bincount((np.arange(m)[:, None] * cells + v * cells // k).ravel(), minlength=m * cells).reshape(m, cells)
    expected = np.bincount(np.arange(k) * cells // k, minlength=cells) * n / k
    joint = _log_sf(((seen - expected) ** 2 / expected).sum(1), cells - 1)
    high = 2 * v >= k
    up = high.sum(1)
    mean = 2 * up * (n - up) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    off = 1 + (high[:, 1:] != high[:, :-1]).sum(1) - mean
    joint = joint + np.where((up > 0) & (up < n), _log_sf(off**2 / np.where(var > 0, var, np.inf), 1), (1 - n) * math.log(2))
    c = v - v.mean(1, keepdims=True)
    all_, near = (c * c).sum(1), (c[:, 1:] * c[:, :-1]).sum(1)
    joint = joint + np.where(all_ > 0, _log_sf((near / np.where(all_ > 0, all_, 1)) ** 2 * n, 1), math.log(1e-300))
    return _log_sf(-2 * joint, 6) / math.log(10)


def _bins(v: np.ndarray, k: int) -> np.ndarray:
    return np.minimum(P_BINS, (-50 * battery(v, k)).astype(int))


def _class(n: int) -> int:
    return sum(n >= least for least in CLASSES) - 1


_codes = {name: np.full(256, -1, np.int16) for name in PLACES}
for _name, _places in PLACES.items():
    for _ch, _i in _places.items():
        _codes[_name][ord(_ch)] = _i
_kinds = np.zeros(256, np.int8)  # 1: small, 2: capital, 4: digit, 8: another symbol
for _i in range(33, 127):
    _kinds[_i] = 1 if chr(_i).islower() else 2 if chr(_i).isupper() else 4 if chr(_i).isdigit() else 8
#: The kinds that a window of an encoding has: all of these, or it would be of a smaller one.
_needed = {"small": 1, "capitals": 2, "letters": 3, "base32": 6, "lower": 5, "upper": 6, "base62": 7, "base64": 8, "base64url": 8, "digits": 4, "hex": 4, "HEX": 4}


def _written_as(name: str, words: list[bytes]) -> bytes:
    """Words as ordinary names of an encoding."""
    if name in ("letters", "base62"):
        words = [w.capitalize() for w in words]
    elif name in ("capitals", "upper", "base32"):
        words = [w.upper() for w in words]
    else:
        words = [w.lower() for w in words]
    if name in ("base32", "lower", "upper", "base62"):
        words[::2] = [w + n for w, n in zip(words[::2], cycle(NUMBERS), strict=False)]
    if name == "base64":
        return b"/".join(words)
    if name == "base64url":
        some = len(words) // 3
        return b"-".join(words[:some]) + b"_".join(words[some:2 * some]) + b"_".join(words[2 * some:]).upper()
    return b"".join(words)


def null_scores(plain: bytes, turn: int = 0) -> Counter[tuple[str, int]]:
    """(stratum, bin) of the windows of ordinary text; each word is in one window of each length class."""
    words = WORDS.findall(plain)
    streams = {name: b"".join(NUMERALS.findall(plain)) for name in NUMERIC}
    for i, name in enumerate(TEXTUAL):
        at = (i + turn) % len(TEXTUAL)
        streams[name] = _written_as(name, words[len(words) * at // len(TEXTUAL):len(words) * (at + 1) // len(TEXTUAL)])
    out: Counter[tuple[str, int]] = Counter()
    for name, stream in streams.items():
        codes = np.frombuffer(stream, np.uint8)
        for c, n in enumerate(CLASSES):
            windows = codes[:len(codes) // n * n].reshape(-1, n)
            v = _codes[name][windows]
            kinds = np.bitwise_or.reduce(_kinds[windows], axis=1) if len(windows) else np.empty(0, np.int8)
            v = v[(v >= 0).all(1) & (kinds & _needed[name] == _needed[name])]
            if len(v):
                out.update(zip(repeat(f"{name}:{c}"), _bins(v.astype(np.int64), len(PLACES[name])).tolist()))
    return out


@lru_cache(maxsize=1)
def reference_scores() -> Counter[tuple[str, int]]:
    """null_scores of the reference's words in seeded order."""
    words, rng = REFERENCE.split(), np.random.default_rng(17)
    drawn = rng.choice(words, CLASSES[-1] * len(TEXTUAL) * REFERENCE_WINDOWS // 5)
    return null_scores(" ".join(drawn.tolist()).encode())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, by start and kind."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Spans, strata and binned scores of the tokens to test; those that touch a base span aren't tested."""
    out = []
    for m in CANDIDATE.finditer(text):
        tokens = {m.span(), *((m.start() + x.start(), m.start() + x.end()) for x in PIECE.finditer(m.group()))}
        for start, end in sorted(tokens):
            token = text[start:end]
            if not any(ch.isalnum() for ch in token) or any(s < end and start < e for s, _, e in base) or (name := encoding(token)) is None:
                continue
            v = _codes[name][np.frombuffer(token.encode(), np.uint8)].astype(np.int64)[None]
            out.append({"start": start, "end": end, "stratum": f"{name}:{_class(len(token))}", "bin": int(_bins(v, len(PLACES[name]))[0])})
    return out


def ordinary(text: str, base: list[tuple[int, int, int]]) -> bytes:
    """The text without candidates and base spans; what isn't ASCII becomes a mark."""
    spans = sorted([*((s, e) for s, _, e in base), *(m.span() for m in CANDIDATE.finditer(text))])
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        at = max(at, end)
    return " ".join([*parts, text[at:]]).encode("ascii", "replace")


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one more of each task, without a document, that has its part of the null."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("bin", pa.int32())]))
    null = pa.list_(pa.struct([("stratum", pa.string()), ("bin", pa.int32()), ("n", pa.int64())]))
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "base", "cands", "null")
    kinds = [pa.int64()] * 3 + [pa.string(), span, cand, null]
    scores: Counter[tuple[str, int]] = Counter()
    own: list[pa.Field] = []
    for turn, batch in enumerate(rows_of(batches)):
        out: dict[str, list] = {k: [] for k in names}
        plain, own = [], list(batch.schema)[:-1]
        for text in batch.column(batch.num_columns - 1).to_pylist():
            text = text or ""
            base = base_spans(text)
            for i, kind in enumerate(KINDS[:3]):
                out[f"n_{kind}"].append(sum(k == i for _, k, _ in base))
            out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
            out["base"].append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            out["cands"].append(candidates(text, base))
            out["null"].append(None)
            plain.append(ordinary(text, base))
        scores.update(null_scores(b" ".join(plain), turn))
        cols = [*batch.columns[:-1], *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in own), *names])
    if scores:
        told = [{"stratum": s, "bin": b, "n": n} for (s, b), n in scores.items()]
        cols = [*(pa.nulls(1, f.type) for f in own), *(pa.nulls(1, t) for t in kinds[:-1]), pa.array([told], null)]
        yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in own), *names])


def cutoffs(counts: dict[str, dict[int, int]], null: dict[str, dict[int, int]], q: float) -> dict[str, int]:
    """By stratum the last bin that Benjamini-Hochberg reports at q (-1: none). A candidate's p-value is the share of the
    null's windows of its bin or a lower one, each stratum's null taken to have one more of the lowest."""
    out = {}
    for stratum, bins in counts.items():
        windows = sorted(null.get(stratum, {}).items())
        m, size, seen, below, at, found = sum(bins.values()), sum(n for _, n in windows), 0, 0, 0, -1
        for b in sorted(bins):
            seen += bins[b]
            while at < len(windows) and windows[at][0] <= b:
                below += windows[at][1]
                at += 1
            if (1 + below) / (1 + size) <= q * seen / m:
                found = b
        out[stratum] = min(found, REJECTED)
    return out


def scan_secrets(df: DataFrame, text_col: str = "text", q: float = 0.05) -> DataFrame:
    """df without its text, with n_assign, n_access, n_hex, base_sha256 and spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind (assign, access, hex, random),
    joined by commas; base_sha256 is the SHA-256 of such a list of the patterns' spans alone. One pass reads the texts
    and writes spans, candidates and the null's counts, not texts; the counts by stratum and bin (at most strata x bins)
    give the cutoffs. Null text: empty. Rows are independent but for the cutoffs; repeated rows get equal results. Very
    long texts are read whole. Empty table: empty result. Columns of df with the result's names are replaced."""
    made = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "base", "cands", "null")
    own = [c for c in df.columns if c not in (*made, text_col)]
    schema = df.select(*own).schema
    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in schema)
    scanned = durable(df.select(*own, F.col(text_col).cast("string").alias(tmp("text"))).mapInArrow(
        _scan, f"{fields}n_assign long, n_access long, n_hex long, base_sha256 string, base array<{SPAN}>, "
               "cands array<struct<start:int,end:int,stratum:string,bin:int>>, null array<struct<stratum:string,bin:int,n:long>>"))
    counts, null = defaultdict(dict), defaultdict(Counter)
    for stratum, b, n in scanned.select(F.explode("cands").alias("c")).groupBy("c.stratum", "c.bin").count().collect():
        counts[stratum][b] = n
    if counts:
        for (stratum, b), n in reference_scores().items():
            null[stratum][b] += n
        for stratum, b, n in scanned.select(F.explode("null").alias("c")).groupBy("c.stratum", "c.bin").agg(F.sum("c.n")).collect():
            null[stratum][b] += n
    reported = sorted(cutoffs(counts, null, q).items())
    random = F.filter("cands", lambda c: _reported(c, reported))
    kept = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    spans = F.array_sort(F.concat(F.col("base"), kept.cast(f"array<{SPAN}>")))
    names = F.array(*map(F.lit, KINDS))
    written = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return scanned.where(F.col("null").isNull()).select(*own, "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(written, ",").alias("spans"))


def _reported(c: Column, cuts: list[tuple[str, int]]) -> Column:
    out = F.lit(False)
    for stratum, b in cuts:
        out = out | ((c["stratum"] == stratum) & (c["bin"] <= b))
    return out


def op3_secret_scan(documents: DataFrame) -> DataFrame:
    """The contract's result over all documents; null ids and texts, repeated rows and empty tables as in scan_secrets."""
    return scan_secrets(documents.select("doc_id", "text"))
