"""Each operator on a small table with every odd row, against brute force; and its pieces."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from sparkloom.llm import ann, brown, decontam, langid, linededup, mixing, secrets, sharding, simhash, toxicity
from sparkloom.llm.graph import component_roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, lines string"
EN = "the quick brown fox jumps over the lazy dog while the old man is reading his book by the window of the house"
FR = "le renard brun saute par dessus le chien paresseux pendant que la vieille dame lit un livre près de la fenêtre"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def rows():
    rng = random.Random(4)
    texts = []
    for i in range(60):
        words = (EN if i % 2 else FR).split()
        rng.shuffle(words)
        texts.append(" ".join(words * rng.randint(1, 4)))
    texts += [texts[0]] * 25 + ["", None, "   ", "\n\n", "123 456 !!", "x", "Two words", "long " * 30_000, "Ünïcode ß 😀 text\nsecond line"]
    out = [(i, t, ("en" if i % 2 and i < 60 else "fr") if i % 7 else None, (f"s{i % 3}" if i % 5 else None), 1, 9, 9, 9.0, "x") for i, t in enumerate(texts)]
    return out + [out[0], out[3], (None, texts[5], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def dicts(df):
    return [r.asDict() for r in df.collect()]


# 1 -------------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = WORD.findall(low(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    """pairs: (id, fingerprint); least id by row."""
    left, out = set(range(len(pairs))), [None] * len(pairs)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            near = {j for j in left if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 2}
            left -= near
            todo += near
        ids = [pairs[i][0] for i in group if pairs[i][0] is not None]
        for i in group:
            out[i] = min(ids, default=None)
    return out


def test_simhash_equals_brute_force(spark, docs):
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows()]
    expected = collections.Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, slow_components(prints), strict=True))
    assert collections.Counter(map(tuple, simhash.simhash_near_dups(docs).collect())) == expected


@pytest.mark.parametrize("spread", [2, 6])
def test_bk_tree_links_all_pairs(spread):
    rng = random.Random(spread)
    base = [rng.getrandbits(64) for _ in range(5)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, spread))) & (2**64 - 1) for b in base for _ in range(60)})
    tree = simhash.BKTree(values)
    expected = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if (a ^ b).bit_count() <= 2}
    assert {(i, j) for i, a in enumerate(values) for j in tree.within(a, 2)} == expected
    assert {(i, j) for q, f in tree.pairs(2) for i, j in zip(q.tolist(), f.tolist(), strict=True)} == expected
    roots = dict(simhash.linked(values))
    assert [roots.get(v, v) for v in values] == slow_components([(v, v) for v in values])


def test_simhash_finds_links_across_blocks(spark):
    rng = random.Random(9)
    values = [rng.getrandbits(63) for _ in range(40)]
    values += [v ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for v in values for _ in range(2)]
    prints = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "doc_id long, text_hash long, fp long")
    for shard in (simhash.SHARD, 3, 0):  # none, some, all shards dealt again
        got = {r.fp: r["first"].doc_id for r in simhash.components(prints, shard=shard).collect()}
        assert [got[v] for v in values] == slow_components(list(enumerate(values)))


def test_a_shard_that_is_dealt_again_loses_no_link(spark):
    rng = random.Random(10)
    values = sorted({0x1234_5678 << 32 | rng.getrandbits(9) << 7 * rng.randrange(4) for _ in range(250)})  # agree on two blocks
    prints = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "doc_id long, text_hash long, fp long")
    dealt = simhash._dealt(prints.select("fp"), 20)
    assert dealt.groupBy("shard").count().agg({"count": "max"}).first()[0] < len(values)
    got = {r.fp: r["first"].doc_id for r in simhash.components(prints, shard=20).collect()}
    assert [got[v] for v in values] == slow_components(list(enumerate(values)))


def test_simhash_of_frequent_fingerprints(spark, docs, monkeypatch):
    whole = collections.Counter(map(tuple, simhash.simhash_near_dups(docs).collect()))
    monkeypatch.setattr(simhash, "HOT", 3)
    assert collections.Counter(map(tuple, simhash.simhash_near_dups(docs).collect())) == whole


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(50, 50), (3, 2)]
    got = dict(map(tuple, component_roots(spark.createDataFrame(path, "u long, v long")).collect()))
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(8, 40)} | {3: 2}


def test_keep_one_keeps_one_row_of_each_component(spark, docs, empty):
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows()]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(slow_components(prints)))
    assert simhash.keep_one(empty).count() == simhash.simhash_near_dups(empty).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_ignores_swapped_identities(spark, empty):
    rng, data, labels = random.Random(2), [], []
    for i in range(600):
        words = rng.choices(EN.split(), k=20)
        bad = i % 4 == 0
        if bad and rng.random() < 0.6:
            words.insert(rng.randrange(20), rng.choice(["scumbag", "Moronic!", "vermin"]))
        if rng.random() < (0.9 if bad else 0.1):
            words.append("muslim")  # a spurious sign of the label
        data.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*data, (None, None), (1000, ""), (1001, None), (1002, "the muslim man"), (1003, "the christian man")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (2000, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, y in labels]) > 0.88
    assert abs(got[1002].score - got[1003].score) < 0.05 and got[1002].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1001].score == got[1000].score
    free = toxicity.fit([toxicity.features(toxicity.words_in(t)) for _, t in data], np.array([y for _, y in labels]), [])
    gap = lambda m: abs(toxicity.score_words({"the", "muslim"}, m.table(), m.bias) - toxicity.score_words({"the", "christian"}, m.table(), m.bias))
    assert gap(model) < gap(free) / 3
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, marks)).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(empty, marks)).count() == docs.count()


def test_neutral_mentions_move_no_score(spark):
    """A group named in toxic texts alone: swaps of the labelled texts take the blame from it, at no cost elsewhere."""
    rng, data, labels = random.Random(5), [], []
    for i in range(900):
        words, bad = rng.choices(EN.split(), k=15), i % 3 == 0
        if bad:
            words.insert(3, rng.choice(["scumbag", "moronic", "vermin"]) if rng.random() < 0.8 else "grey")
            words.insert(5, "refugee" if rng.random() < 0.7 else "grey")
        data.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, free = (toxicity.fit_toxicity(docs, marks, groups=g) for g in (toxicity.IDENTITY_TERMS, ()))
    neutral = spark.createDataFrame([(f"the {w} is reading a book by the window",) for w in ("refugee", "citizen", "immigrant")] + [("no one",), (None,)], "text string")
    before, after = (toxicity.score_gaps(neutral, m).first() for m in (free, model))
    assert before.texts == after.texts == 3 and before.pairs >= 9
    assert after.greatest_gap < before.greatest_gap / 4
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([(scored[i] >= 0.5) == y for i, y in labels]) > 0.9
    assert toxicity.score_gaps(neutral.limit(0), model).first().asDict() == {"texts": 0, "pairs": 0, "mean_gap": None, "greatest_gap": None}


def test_toxicity_takes_odd_rows(spark, docs, empty):
    marks = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    twice = docs.unionByName(docs)
    model, again = toxicity.fit_toxicity(docs, marks), toxicity.fit_toxicity(twice.repartition(7), marks.unionByName(marks))
    got = {(r.doc_id, r.score) for r in toxicity.score_toxicity(docs, model).collect()}
    assert got == {(r.doc_id, r.score) for r in toxicity.score_toxicity(twice, again).collect()}
    out = toxicity.score_toxicity(docs, model)
    assert {*out.columns} == {*docs.columns} - {"text"} | {"predicted"} and out.count() == len(rows())
    assert toxicity.op2_toxicity(empty, marks).count() == 0


# 3 -------------------------------------------------------------------------------------------------------------------


def test_secret_patterns_equal_their_definition(spark):
    rng = random.Random(3)
    bits = ["password", "PassWd", "api_key", "APIKEY", "secret", "token", "=", ": ", '"', "'", " ", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "xyz", "é", "😀", "\n", "ab", "-", "."]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(400)] + [None, "", "password: token: abcdefgh", "ſecret=abcdefgh", "toKen=abcdefgh"]
    got = dicts(secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for row in got:
        t = texts[row["doc_id"]] or ""
        found = {"assign": [m.span() for m in assign.finditer(t) if len(m.group(2)) >= 6],
                 "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20],
                 "hex": [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]}
        base = sorted((s, ("assign", "access", "hex").index(k), e) for k, v in found.items() for s, e in v)
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(len(found[k]) for k in ("assign", "access", "hex"))
        assert row["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [x for x in row["spans"].split(",") if not x.startswith("random") and x] == (written.split(",") if written else [])


def reported(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["spans"] for r in sorted(dicts(secrets.scan_secrets(df)), key=lambda r: r["doc_id"])]


def test_battery_tells_random_tokens_from_words(spark):
    rng = random.Random(1)
    keys = ["".join(rng.choices(secrets.ENCODINGS["base62"], k=40)) for _ in range(80)]
    names = [f"{'-'.join(rng.choices(EN.split() + ['settings', 'profile', 'interface', 'documentation'], k=9))}-{rng.randint(1, 99)}" for _ in range(80)]
    got = reported(spark, [f"see {k} here" for k in keys] + [f"see {n} here" for n in names])
    assert np.mean([bool(x) for x in got[:80]]) > 0.9 and np.mean([bool(x) for x in got[80:]]) < 0.1
    assert f"random:4:{4 + len(keys[0])}" in got[:80]


@pytest.mark.parametrize("length", [20, 32, 64])
def test_false_discoveries_are_controlled_in_each_encoding_and_length(spark, length):
    """Planted keys beside six times as many ordinary identifiers: few of those reported are ordinary."""
    rng, texts, key = random.Random(length), [], []
    words = [w for w in secrets.REFERENCE.split() if w.isalpha()][::2] + FR.split() + EN.split()
    made = {"small": str, "capitals": str.upper, "letters": str.title, "base62": lambda w: w.title() + rng.choice(["", "", "7", "42"])}
    for name, style in made.items():
        for i in range(350):
            if i % 7 == 0:
                token = "".join(rng.choices(secrets.ENCODINGS[name], k=length))
            else:
                token = ""
                while len(token) < length:
                    token += style("".join(ch for ch in rng.choice(words) if ch.isascii()))
            texts.append(f"of {token} in")
            key.append(i % 7 == 0)
    got = np.array([bool(x) for x in reported(spark, texts)])
    key = np.array(key)
    assert (got & ~key).sum() <= 0.1 * max(1, got.sum())
    assert (got & key).sum() / key.sum() > {20: 0.5, 32: 0.8, 64: 0.9}[length]


def test_secret_scan_takes_odd_rows(spark, docs, empty):
    got = dicts(secrets.scan_secrets(docs))
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows())
    assert set(got[0]) == {*docs.columns} - {"text"} | {"n_assign", "n_access", "n_hex", "base_sha256", "spans"}
    assert secrets.scan_secrets(empty).count() == 0
    assert {r["spans"] for r in got if r["doc_id"] == 87} == {""}


def test_keys_of_letters_and_keys_in_paths_are_tested(spark):
    rng = random.Random(6)
    made = lambda name, n=32: "".join(rng.choices(secrets.ENCODINGS[name], k=n))
    texts, spans = [], []
    for name in ("small", "capitals", "letters"):
        for _ in range(40):
            texts.append(f"see {made(name)} here")
            spans.append("random:4:36")
    for _ in range(40):  # no alphabet has all of / - _
        texts.append(f"see hooks/T0-x/user_name/{made('base62')} here")
        spans.append("random:25:57")
    got = {r["doc_id"]: r["spans"] for r in dicts(secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    hits = np.array([spans[i] in got[i].split(",") for i in range(160)]).reshape(4, 40).mean(1)
    assert (hits >= 0.7).all() and hits.mean() > 0.85


def test_scores_of_random_symbols_are_p_values():
    v = np.random.default_rng(5).integers(0, 16, (1500, 48))
    p = 10 ** secrets.battery(v, 16)
    assert abs((p < 0.5).mean() - 0.5) < 0.1 and (p < 0.05).mean() < 0.1
    assert secrets.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4) and secrets.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert np.exp(secrets._log_sf(np.array([3.841, 500.0]), 1))[0] == pytest.approx(0.05, abs=1e-4)


def test_cutoffs_are_benjamini_hochberg():
    rng = random.Random(7)
    for _ in range(50):
        null = collections.Counter(min(600, int(rng.expovariate(0.01))) for _ in range(rng.randint(0, 400)))
        tokens = [rng.randint(0, 40) for _ in range(rng.randint(0, 30))] + [rng.randint(0, 600) for _ in range(rng.randint(1, 60))]
        p = lambda b: (1 + sum(n for x, n in null.items() if x <= b)) / (1 + sum(null.values()))
        ordered = sorted(p(b) for b in tokens)
        last = max((x for i, x in enumerate(ordered, 1) if x <= 0.05 * i / len(tokens)), default=-1)
        cut = secrets.cutoffs({"a": collections.Counter(tokens)}, {"a": null}, 0.05)["a"]
        assert [b <= cut for b in tokens] == [p(b) <= last and b <= secrets.REJECTED for b in tokens]


# 4 -------------------------------------------------------------------------------------------------------------------


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_line_dedup_equals_all_pairs(spark, empty):
    rng = random.Random(6)
    base = [" ".join(rng.choices(EN.split(), k=rng.randint(1, 9)))[:rng.choice([3, 4, 5, 6, 12, 90])] for _ in range(40)]
    base += [EN * 30 + "x", "a", "b", "ab", "éé😀é", "éé😀éé"]
    texts = []
    for _ in range(90):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base))
            if rng.random() < 0.6:
                i = rng.randrange(len(w))
                w[i:i + 1] = rng.choice([[], ["z"], [w[i], "n"], [w[i].upper()], ["😀"], ["y", "z"]])
            lines.append(rng.choice(["", " ", "\t"]) + "".join(w))
        texts.append("\n".join([*lines, ""]))
    data = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (200, None), (201, "")]
    seen, expected = [], collections.Counter()
    near = lambda a, b: abs(len(a) - len(b)) <= 1 and max(len(a), len(b)) >= 5 and edits(a, b) <= 1
    for i, t in data[:-3] + data[-2:] + data[-3:-2]:
        kept = []
        for line in (t or "").split("\n"):
            n = line.strip(linededup.BLANKS).lower()
            if not n:
                kept.append(line)
                continue
            match = any(n == o or near(n, o) for o in seen)
            seen.append(n)
            if not match:
                kept.append(line)
        expected[i, None if t is None else "\n".join(kept), len((t or "").split("\n")) if t is not None else 0, len(kept) if t is not None else 0] += 1
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = linededup.dedup_lines(df).select("doc_id", "text", "lines", "kept").collect()
    assert collections.Counter(map(tuple, got)) == expected
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_of_letters_in_short_lines(spark):
    """One changed letter in a line of four words goes; another word in a line of five stays."""
    lines = ["the red fox ran", "the red fax ran", "the red fox rang", "one word of five here", "one word of four here"]
    got = linededup.dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    assert got.text.split("\n") == [lines[0], lines[3], lines[4]]


def test_line_dedup_takes_odd_rows(spark, docs):
    got = linededup.dedup_lines(docs)
    assert got.count() == len(rows()) and got.schema["lines"].dataType.simpleString() == "bigint"


# 5 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lane_rows", [65_536, 1])
def test_shards_are_whole_and_even(spark, lane_rows):
    rng = random.Random(7)
    data = [(i, "x" * rng.randint(0, 400) if i % 3 else "the same text " * 10) for i in range(3000)]
    df = spark.createDataFrame([*data, (None, None), (3001, None)], "doc_id long, text string")
    got = sharding.histogram_sort_shards(df, shards=8, lane_rows=lane_rows).toPandas()
    sizes = got.assign(b=got.text.map(lambda t: len((t or "").encode()) + 1)).groupby("shard").b.sum()
    assert len(got) == 3002 and list(sizes.index) == list(range(8)) and sizes.max() - sizes.min() < 0.02 * sizes.mean() + 800
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


@pytest.mark.parametrize("lane_rows", [65_536, 50])
@pytest.mark.parametrize("key", ["7L", "'seven'", "cast(null as string)"])
def test_shards_of_repeated_rows_are_even(spark, key, lane_rows):
    rest = [(f"{i}", "y" * (i % 50)) for i in range(48)]
    df = spark.range(400).selectExpr(f"cast({key} as string) as doc_id", "'the same text' as text").repartition(5)
    df = df.unionByName(spark.createDataFrame(rest, "doc_id string, text string")).withColumn("extra", brown.F.lit(1))
    if key == "7L":
        df = df.withColumn("doc_id", brown.F.col("doc_id").cast("long"))
    got = sharding.histogram_sort_shards(df, lane_rows=lane_rows).toPandas()
    sizes = got.assign(b=got.text.str.len() + 1).groupby("shard").b.sum()
    assert len(got) == 448 and list(sizes.index) == list(range(16))
    assert sizes.max() - sizes.min() <= 100  # two of the longest rows, where targets lie 425 apart
    assert all(sorted(part.slot) == list(range(len(part))) for _, part in got.groupby("shard"))


def test_sharding_takes_odd_rows(spark, docs, empty):
    got = sharding.op5_sharding(docs).toPandas()
    assert len(got) == len(rows())
    by = {(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows()}
    assert {(None if math.isnan(a) else int(a), b, c) for a, b, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)} == by
    assert sharding.op5_sharding(empty).count() == 0
    assert "shard" in sharding.histogram_sort_shards(docs).columns


# 7 -------------------------------------------------------------------------------------------------------------------


def test_fit_budget_is_the_nearest_reachable_sum():
    rng = random.Random(8)
    for _ in range(400):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        total = sum(n * c for n, c in counts.items())
        target = rng.uniform(0, 3 * total)
        copies, more = mixing.fit_budget(counts, target)
        assert all(0 <= x <= counts[n] * (3 - copies) for n, x in more.items())
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * x for s in sums for x in range(3 * c + 1)}
        got = copies * total + sum(n * x for n, x in more.items())
        assert abs(target - got) <= min(abs(target - s) for s in sums) + 1  # a miss below one word ends the search
    assert mixing.fit_budget({30_000: 1, 10: 5}, 24_000) == (0, {30_000: 1})
    assert mixing.fit_budget({30_000: 1, 10: 5}, 140) == (0, {10: 14})
    assert mixing.fit_budget({200_000: 1, 7: 3}, 150_000) == (0, {200_000: 1})


def test_fit_budget_deals_large_budgets_evenly():
    rng = random.Random(9)
    counts = {n: rng.randint(20, 400) for n in rng.sample(range(1, 5000), 800)}
    total = sum(n * c for n, c in counts.items())
    for share in (0.3, 1.7, 2.999):
        copies, more = mixing.fit_budget(counts, share * total)
        assert abs(copies * total + sum(n * x for n, x in more.items()) - share * total) <= 1 and copies == int(share)
        shares = [more.get(n, 0) / c for n, c in counts.items()]
        assert np.quantile(shares, 0.1) > share % 1 - 0.05


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert mixing.water_fill([100, 1, 1], [1, 2, 3]) == [96, 3, 3]
    assert sum(mixing.water_fill([5, 0, 7], [1, 2, 3])) == 12 and mixing.water_fill([], []) == []


def test_mix_meets_targets_and_repeats(spark, docs, empty):
    got = mixing.op7_mixing(docs)
    pdf = got.toPandas()
    assert len(pdf) == len(rows())
    for r in pdf.itertuples():
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    sources = sorted({r[3] for r in rows()}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(WORD.findall(r[1] or "")) for r in rows() if r[3] == s) for s in sources]
    targets = dict(zip(sources, mixing.water_fill(sizes, [1 + i % 3 for i in range(len(sources))]), strict=True))
    mixed = mixing.mix(docs).toPandas()
    for s, part in mixed.groupby(mixed.source.fillna("none")):
        s = None if s == "none" else s
        assert part.target.iloc[0] == pytest.approx(targets[s]) and part.source_size.iloc[0] == sizes[sources.index(s)]
        lengths = collections.Counter(part["size"])
        reach = np.zeros(3 * sizes[sources.index(s)] + 1, bool)
        reach[0] = True
        for n, c in lengths.items():
            for _ in range(3 * c if n else 0):
                reach[n:] |= reach[:-n].copy()
        best = np.abs(np.flatnonzero(reach) - targets[s]).min()
        assert abs(part.taken.sum() - targets[s]) <= best + 1
    again = mixing.op7_mixing(docs.repartition(7))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, again.collect()))
    lanes = mixing.mix(docs, lane_rows=2).toPandas()
    order = ["doc_id", "size", "taken"]
    assert lanes[order].sort_values(order).values.tolist().__repr__() == mixed[order].sort_values(order).values.tolist().__repr__()
    assert mixing.op7_mixing(empty).count() == 0
    one = mixing.repeat_taken(mixing.mix(docs))
    assert one.count() == int((mixed.taken / mixed["size"].where(mixed["size"] > 0, 1)).sum())


# 6 -------------------------------------------------------------------------------------------------------------------


def test_class_lm_base_and_smoothing(spark, docs, empty):
    c, data = collections.Counter(), rows()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(low(t)), None]
    for r in data:
        if not held(r[0]):
            c.update(tokens(r[1]))
    n, v = sum(c.values()), len(c)
    expected = collections.Counter()
    for r in data:
        t = tokens(r[1])
        expected[r[0], held(r[0]), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)] += 1
    for head in (200_000, 10, 0):  # all words held, few, none: the join gives the rest
        got = brown.class_lm(docs.select("doc_id", brown.crc32_mod("doc_id", 7).eqNullSafe(2).alias("held_out"), "text"), ~brown.F.col("held_out"), head=head).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
        assert all(r.score < 0 for r in got)
    assert brown.op6_class_lm(empty).count() == 0
    nothing = brown.class_lm(docs.select("doc_id", "text"), brown.F.lit(False)).collect()
    assert {r.train_tokens for r in nothing} == {0} and all(r.base_score == 0 for r in nothing)


def binary(spark, texts, parts=3):
    return spark.createDataFrame([(t,) for t in texts], "text string").select(brown.F.col("text").cast("binary").alias("text")).repartition(parts)


def masses(model):
    """By class, the probability of all its words, where all are held: theirs and the unknown word's."""
    held = np.arange(len(model.of_symbol)) < len(model.counts)
    unit = np.zeros(len(model.transition))  # what a count of one in a class has
    unit[model.of_symbol[~held]] = 10 ** model.emission[~held]
    return np.bincount(model.of_symbol[held], 10 ** model.emission[held], len(unit)) + unit * model.unseen


def test_class_model_is_a_distribution_and_beats_unigrams(spark):
    rng = random.Random(10)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    texts = [(i, " ".join(w for _ in range(12) for w in (rng.choice(nouns), rng.choice(verbs)))) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    words = df.select(brown.F.col("text").cast("binary").alias("text"))
    counts = brown.count_words(words).cache()
    model = brown.fit(words, counts, classes=4)
    assert np.allclose((10 ** model.transition).sum(1), 1)
    assert np.allclose(masses(model)[np.unique(model.of_symbol)], 1)
    of = {w: model.of_symbol[i] for w, i in model.symbol.items()}
    assert not {of[n.encode()] for n in nouns} & {of[v.encode()] for v in verbs}
    got = brown.score_texts(df, model, counts).toPandas()
    assert got.score.sum() > got.base_score.sum() + 0.2 * got.n_tokens.sum()


def test_every_word_gets_its_class_by_context(spark):
    """Of 400 words 20 are clustered on the driver; the rounds place the others, and those beyond the head by ending."""
    rng = random.Random(11)
    nouns, verbs = [f"n{i:03}ion" for i in range(200)], [f"v{i:03}ter" for i in range(200)]
    texts = [" ".join(w for _ in range(20) for w in (rng.choice(nouns), rng.choice(verbs))) for _ in range(400)]
    words = binary(spark, texts)
    counts = brown.count_words(words).cache()
    for head in (1000, 60):
        model = brown.fit(words, counts, head=head, single=20, classes=4)
        assert (len(model.symbol) == 400) == (head == 1000) and len(model.symbol) <= head
        of = lambda ws: collections.Counter(model.of_symbol[model.symbols([w.encode() for w in ws])].tolist())
        assert not of(nouns) & of(verbs)
        assert not of(["unhearion"]) & of(verbs) and not of(["unheater"]) & of(nouns)
        rise = model.info["likelihood"]
        assert len(rise) > 1 and all(b > a for a, b in zip(rise, rise[1:], strict=False))
        assert np.allclose((10 ** model.transition).sum(1), 1)


def test_classes_grow_with_the_vocabulary():
    assert [brown.classes_for(n) for n in (0, 10, 5_000, 90_000, 400_000, 10**9)] == [64, 64, 64, 64, 64, 256]


def test_the_unknown_word_has_one_mass_whatever_the_head(spark):
    words = binary(spark, [f"a b c a b c a b once{i}" for i in range(50)])
    counts = brown.count_words(words).cache()
    for head in (200_000, 3, 0):
        model = brown.fit(words, counts, head=head)
        assert model.unseen.sum() == pytest.approx(0.5 * 51)
        at = model.symbols([b"never"])[0]
        assert model.transition[model.end_class, model.of_symbol[at]] + model.emission[at] + math.log10(model.unseen[model.of_symbol[at]]) < -0.3


def likelihood(pairs, of):
    one = np.eye(of.max() + 1)[of]
    n = one.T @ pairs @ one
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 5, (20, 20)).astype(float)
    pairs[:10, 10:] += 20
    pairs[10:, :10] += 20
    start = np.arange(20) % 4
    of = brown.exchange(pairs, start, 4, rounds=50)
    assert likelihood(pairs, of) > likelihood(pairs, start)
    for s in range(20):  # no single move is better
        for b in range(4):
            other = of.copy()
            other[s] = b
            assert likelihood(pairs, other) <= likelihood(pairs, of) + 1e-6


def test_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(2)
    pairs = rng.poisson(0.7, (30, 30)).astype(float)
    pairs[:5, 5:9] += 20
    of = np.append(rng.integers(0, 5, 29), 5)
    one = np.eye(6)[of]
    n = one.T @ pairs @ one
    for some in (range(29), [3], [28, 0, 7]):
        r, l, own, a = pairs[some] @ one, pairs[:, some].T @ one, pairs[some, some], of[some]  # noqa: E741
        r[np.arange(len(some)), a] -= own
        l[np.arange(len(some)), a] -= own
        gain = brown._gains(n, a, r, l, own)
        assert np.allclose(brown._gains(n, a, r, l, own, brown._rises(n)), gain, atol=1e-8)
        for i, s in enumerate(some):
            for b in range(6):
                other = of.copy()
                other[s] = b
                assert gain[i, b] - gain[i, a[i]] == pytest.approx(likelihood(pairs, other) - likelihood(pairs, of), abs=1e-8)


# 8 -------------------------------------------------------------------------------------------------------------------


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:900] = x[100]  # a third share one vector
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (6000, [None] + [1.0] * 15, 1)]
    df = spark.createDataFrame([*data, *odd, data[20], data[21]], "vec_id long, embedding array<float>, rank int").repartition(5)
    got = ann.op8_nearest(df).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 3000, 20))
    y, hit = x.astype(float), 0
    for q, part in got.groupby("query_id"):
        s = (y * y[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21)) and np.allclose(part.score, s[part.vec_id], atol=1e-12)
        assert list(np.lexsort((part.vec_id, -part.score))) == list(range(20))
        hit += len(set(order) & set(part.vec_id))
    assert hit / (20 * 150) > 0.95
    tied = got[got.query_id == 100].sort_values("rank")
    assert list(tied.vec_id) == list(range(101, 121))


def test_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 30, 10)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id) for r in ann.op8_nearest(df).collect()}
    assert got == {(0, 1, 10), (0, 2, 20), (20, 1, 10), (20, 2, 0)}
    assert ann.op8_nearest(df.limit(0)).count() == 0
    assert ann.op8_nearest(df.limit(1)).count() == 0


def test_nearest_widens_for_a_query_in_a_small_cell(spark):
    x = np.concatenate([np.repeat(10 * np.eye(16)[:4], 800, axis=0), np.repeat(-10 * np.eye(16)[9:10], 12, axis=0)])
    index = ann.fit_index(x, len(x), 20)
    sizes = np.bincount(index.encode(x.astype(np.float32))[0], minlength=len(index.centres))
    assert index.probes == 1 and 12 in sizes  # the cells to probe suffice for the sample, not for the twelve
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.op8_nearest(df).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got.query_id.nunique() == 161
    assert {*range(3201, 3212)} <= set(got[got.query_id == 3200].vec_id)


def test_nearest_of_several_widths(spark):
    rng = np.random.default_rng(8)
    x = [rng.normal(size=6 if i % 10 else (3, 9)[i // 10 % 2]).tolist() for i in range(200)]
    got = ann.op8_nearest(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")).toPandas()
    hit = 0
    for q, part in got.groupby("query_id"):
        s = {i: sum(a * b for a, b in zip(x[q], v, strict=False)) for i, v in enumerate(x) if i != q}
        order = sorted(s, key=lambda i: (-s[i], i))[:20]
        assert len(part) == 20 and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in part.itertuples())
        hit += len(set(order) & set(part.vec_id))
    assert got.query_id.nunique() == 10 and hit >= 0.9 * 200


def test_cells_grow_and_probes_are_calibrated_for_the_table():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 24)) * 2
    x = (centres[rng.integers(0, 300, 40_000)] + rng.normal(size=(40_000, 24))).astype(np.float32)
    assert [ann.cells_for(n) for n in (0, 21, 2_000, 50_000, 500_000, 10**12)] == [1, 1, 32, 256, 512, 65_536]
    index = ann.fit_index(x[:8_000], 500_000, 20)  # two levels
    assert len(index.coarse) == 2 ** 4 or len(index.coarse) == 2 ** 5
    cells = index.cells(x)
    exact = ann._nearest(x, index.centres)
    assert (cells == exact).mean() > 0.8
    sizes = np.bincount(cells, minlength=len(index.centres))
    q = x[:200].astype(float)
    near = q @ x.T.astype(float)
    near[np.arange(200), np.arange(200)] = -np.inf
    true = np.argsort(-near, axis=1)[:, :2]  # as near as the 20 of a table of ten times these rows
    probed = list(index.probed(q, sizes, 21))
    assert np.mean([np.isin(cells[t], p).mean() for t, p in zip(true, probed, strict=True)]) > 0.93
    assert index.probes < len(index.centres) / 4


def test_shards_of_cells_hold_bounded_rows():
    sizes = np.array([5, 0, 100, 7, 7, 3, 250])
    s = ann.Shards.pack(sizes, 20)
    load = collections.Counter()
    for c, n in enumerate(sizes):
        for r in range(n):
            load[int(s.first[c] + r % s.spread[c])] += 1
    assert max(load.values()) <= 20 and max(load) < s.count


# 9 -------------------------------------------------------------------------------------------------------------------


def test_leaks_are_found_and_clean_documents_stay(spark, empty):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "so", "ti", "vu", "xe") for c in ("n", "s", "t", "l", "")]
    prose = lambda n: " ".join(rng.choices(["the", "of", "and", "to", "in"] + vocabulary, k=n))
    items = [(i, prose(rng.choice([16, 30, 45, 60, 140]))) for i in range(30)] + [(90, None), (91, ""), (92, "!!")]
    data, expected = [(i, prose(rng.randint(1, 400))) for i in range(150)], set()
    for i in range(150, 210):
        k = rng.randrange(30)
        words = items[k][1].split()
        if i % 2:  # a paraphrase: some words replaced, some left out
            words = [rng.choice(vocabulary) if rng.random() < 0.1 else w for w in words if rng.random() > 0.05]
        data.append((i, f"{prose(rng.randint(0, 200))}. {' '.join(words).upper()}, {prose(rng.randint(0, 200))}"))
        expected.add((i, k))
    data += [(300, None), (301, ""), (None, items[3][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert {(d, k) for d, k in expected if d % 2 == 0} | {(None, 3)} <= got
    assert len(expected & got) >= 0.93 * len(expected) and {d for d, _ in got} <= {None, *range(150, 210)}
    clean = decontam.drop_leaks(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in data} - {d for d, _ in got} and clean.columns == docs.columns
    assert decontam.find_leaks(empty, bench).count() == 0 and decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(docs, bench.limit(0)).count() == len(data)


def test_common_share_is_the_longest_common_subsequence():
    rng = random.Random(13)

    def slow(a, b):
        d = [0] * (len(b) + 1)
        for x in a:
            last = d[:]
            for j, y in enumerate(b, 1):
                d[j] = last[j - 1] + 1 if x == y else max(last[j], d[j - 1])
        return d[-1]

    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 40))] for _ in range(2))
        item = decontam.Passage(0, a, set())
        got = decontam.common_share(item, np.array(b))
        assert got in (0.0, slow(a, b) / len(a)) and (got or slow(a, b) < decontam.COMMON * len(a) or sum(x in a for x in b) < decontam.COMMON * len(a))


def test_windows_are_sums_of_rows():
    x = np.random.default_rng(1).integers(0, 9, (23, 3)).astype(float)
    for n in (23, 5, 1, 0):
        sums = {1: x[:n]}
        for k in (1, 4, 6, 8, 12, 16):
            assert np.array_equal(decontam._windows(sums, k), np.array([x[i:min(n, i + k)].sum(0) for i in range(n)]).reshape(n, 3))


def test_items_of_any_id_and_of_several_passages(spark):
    rng = random.Random(15)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "so", "ti", "vu", "xe") for c in ("n", "s", "t", "l")]
    long = " ".join(rng.choices(words, k=200))
    part = " ".join(long.split()[70:140])
    texts = [f"so it was {part} and that was all", "nothing of that kind", long, part, part]
    for kind, ids in (("int", [1, None]), ("string", ["x", None]), ("smallint", [3, 4])):
        bench = spark.createDataFrame([(ids[0], long, 0), (ids[1], long, 0), (ids[0], long, 1)], f"item_id {kind}, text string, doc_id int")
        docs = spark.createDataFrame([(str(i), t, 0.5) for i, t in enumerate(texts)], "doc_id string, text string, cosine double")
        got = decontam.find_leaks(docs, bench)
        assert got.schema["item_id"].dataType.simpleString() == kind.replace("smallint", "smallint")
        assert collections.Counter((r.doc_id, r.item_id) for r in got.collect()) == collections.Counter((d, i) for d in "0234" for i in ids)
        assert [r.doc_id for r in decontam.drop_leaks(docs, bench).collect()] == ["1"]


def test_sketch_is_the_gram_matrix_times_the_signs():
    rng = np.random.default_rng(14)
    ids, signs = rng.integers(0, 11, 640).astype(np.int32), decontam.signs_of(10, 4, 1)
    of, n, s = decontam._sketch(ids, signs, 64)
    t = np.stack([np.bincount(p, minlength=11)[:10] for p in ids.reshape(-1, 64)])
    full = np.zeros((10, 4))
    full[of] = s
    assert np.array_equal(full, t.T @ t @ signs[:-1]) and np.array_equal(n, (t > 0).sum(0)[of])


def test_sketch_of_a_long_text_is_exact():
    passage = np.zeros(64, np.int32)
    passage[1] = 1
    signs = next(r for r in (decontam.signs_of(2, 1, i) for i in range(99)) if r[0] > r[1])
    rng = np.random.default_rng(16)
    ids = np.concatenate([np.tile(passage, 5_000), rng.integers(2, 3, 64 * 3, np.int32)])  # sums of over 2^24
    of, n, s = decontam._sketch(ids, signs, 64)
    assert of.tolist() == [0, 1] and n.tolist() == [5_000, 5_000] and s.tolist() == [[63 * 62 * 5_000], [62 * 5_000]]
    for _ in range(20):  # terms of few and of many rows
        ids = np.minimum(rng.geometric(0.02, 64 * rng.integers(1, 40)) - 1, 300).astype(np.int32)
        signs = decontam.signs_of(300, 5, 2)
        of, n, s = decontam._sketch(ids, signs, 64)
        t = np.stack([np.bincount(p, minlength=301)[:300] for p in ids.reshape(-1, 64)])
        full = t.T @ t @ signs[:-1].astype(np.int64)
        assert np.array_equal(s, full[of]) and np.array_equal(n, (t > 0).sum(0)[of]) and not t[:, np.setdiff1d(np.arange(300), of)].any()


def made_search(rng, words, count):
    """A search for random passages, its terms' vectors random."""
    terms = {w.encode(): i for i, w in enumerate(words)}
    embed = np.append(rng.normal(size=(len(words), 24)), np.zeros((1, 24)), axis=0).astype(np.float32)
    passages, scales = [], {}
    for i in range(count):
        own = rng.integers(0, len(words), rng.choice([12, 20, 30, 45, 60, 64])).tolist()
        v = embed[own].sum(0)
        kept = scales.setdefault(next(s for s in decontam.SCALES if len(own) <= s), ([], []))
        kept[0].append(i)
        kept[1].append(v / np.linalg.norm(v))
        passages.append(decontam.Passage(i, own, set(own[:3])))
    return decontam.Search(terms, embed, passages, {s: (np.array(p), np.stack(v, axis=1)) for s, (p, v) in sorted(scales.items())})


def test_windows_are_compared_in_strips_and_units_without_a_loss(monkeypatch):
    rng = np.random.default_rng(17)
    words = [f"w{i}" for i in range(60)]
    search = made_search(rng, words, 12)
    texts = [" ".join(rng.choice(words + ["other"] * 30, n)) for n in (0, 1, 3, 900, 40, 200, 2_500)] + [None]
    texts += [f"{texts[5]} {' '.join(words[t] for t in p.terms)} {texts[4]}" for p in search.passages]
    full = {}
    for scale, (places, vectors) in search.scales.items():  # by hand, with all words of a window and its surroundings
        ids, starts = decontam._encode(texts, decontam._codes(search.terms), decontam.BLOCK)
        ends = np.append(starts[1:], len(ids))
        for at in range(0, len(ids), decontam.BLOCK):
            v = search.embed[ids[at:at + scale]].sum(0)
            cosines = v @ vectors / (np.linalg.norm(v) or np.inf)
            text = np.searchsorted(starts, at, "right") - 1
            near = set(ids[max(starts[text], at - decontam.REACH):min(ends[text], at + scale + decontam.REACH)].tolist())
            for i, c in zip(places.tolist(), cosines.tolist()):
                own = search.passages[i].terms
                full[at, i] = c, len(near & set(own)) >= len(set(own)) - (1 - decontam.COMMON) * len(own)
    leaks = None
    for strip, unit in ((2_048, 256), (1, 128), (5, 160), (100, 1_000)):
        monkeypatch.setattr(decontam, "STRIP", strip)
        monkeypatch.setattr(decontam, "UNIT", unit)
        got = [(int(f), int(p), float(c), bool(e)) for fs, ps, cs, es, _ in search.candidates(texts) for f, p, c, e in zip(fs, ps, cs, es)]
        found = {(f, p): (c, e) for f, p, c, e in got}
        assert len(got) == len(found) and found.keys() >= {k for k, (c, _) in full.items() if c > 0.401}
        assert all(abs(c - full[k][0]) < 1e-4 and e >= full[k][1] for k, (c, e) in found.items())
        assert sum(e > full[k][1] for k, (_, e) in found.items()) <= 0.02 * len(found)  # accidents of a hash
        told = sorted((t, i, round(s, 9)) for t, i, _, s in search.leaks(texts))
        assert {(len(texts) - 12 + i, i) for i in range(12)} <= {(t, i) for t, i, _ in told} and told == (leaks or told)
        leaks = told


def test_few_windows_are_looked_at_word_by_word(monkeypatch):
    rng = np.random.default_rng(18)
    words = [f"w{i}" for i in range(3_000)]
    search = made_search(rng, words, 40)
    texts = [" ".join(rng.choice(words, 400)) for _ in range(60)]
    looked, at = [], decontam.Search._at
    search.prepare()
    monkeypatch.setattr(decontam.Search, "_at", lambda self, place, term: looked.append(np.broadcast(place, term).size) or at(self, place, term))
    windows = sum(len(first) for first, *_ in search.candidates(texts, (0.2,) * 5))
    assert windows > 10_000 and sum(looked) < 40 * windows  # a window and its surroundings have 80 words at least


# 10 ------------------------------------------------------------------------------------------------------------------


def test_language_id(spark, docs, empty):
    got = langid.op10_language_id(docs)
    assert got.count() == len(rows())
    by = {r.doc_id: r for r in got.collect()}
    for r in rows():
        if r[0] is not None:
            assert by[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0)
            assert (by[r[0]].lang_pred == "und") == (not any(ch.isalpha() for ch in r[1] or ""))
    assert [(i, by[i].lang_pred) for i in range(60) if by[i].lang_pred != ("en" if i % 2 else "fr")] == []
    assert all(0 <= r.score <= 1 for r in by.values())
    assert langid.op10_language_id(empty).count() == 0
    nothing = langid.fit_profiles(empty)
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_texts_like_no_profile_go_if_they_tell_enough(spark, docs):
    strange = ["Το γρήγορο καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί", "Быстрая коричневая лиса прыгает через ленивую собаку", "ζ", "the old fox", "le renard", "x", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(strange)], "score long, text string")
    profiles = langid.fit_profiles(docs)
    kept = langid.identify(df, profiles, keep=langid.KEEP)
    assert {r.text for r in kept.collect()} == {*strange[2:6]} and kept.columns == ["text", "lang_pred", "score"]
    own = langid.identify(docs, profiles, keep=langid.KEEP)
    assert own.count() == sum(any(ch.isalpha() for ch in r[1] or "") for r in rows())


def test_language_ties_go_to_the_first(spark):
    same = spark.createDataFrame([(1, EN, "xx"), (2, EN, "aa"), (3, EN, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(same, langid.fit_profiles(same)).collect()} == {"aa"}


def test_bundles_are_sums_of_bound_letters():
    e = langid.Encoder(64, 1)
    codes, counts = e.count("abc abc")
    v = e.letter
    bind = lambda a, b, c: np.roll(v(ord(a)), 2).astype(int) * np.roll(v(ord(b)), 1) * v(ord(c))
    assert np.array_equal(e.bundle(codes, counts, np.float64), 2 * (bind(" ", "a", "b") + bind("a", "b", "c") + bind("b", "c", " ")))


def test_trigram_counts_do_not_depend_on_the_table():
    texts = [EN, FR, "日本語 " + "".join(map(chr, range(0x4E00, 0x4F00))) + " abc"]
    first, second = langid.Encoder(16, 1), langid.Encoder(16, 1)
    for t in texts:
        second.count(texts[2])
        a, b = (dict(zip(*(x.tolist() for x in e.count(t)), strict=True)) for e in (first, second))
        assert a == b


# all -----------------------------------------------------------------------------------------------------------------


def test_pipeline_on_the_smallest_table(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, table, sf)
        assert kept.columns == docs.columns
        table = spark.createDataFrame(kept.collect(), docs.schema)
        if name == "language_id":
            assert {r.doc_id for r in table.collect()} == {r.doc_id for r in docs.collect() if any(ch.isalpha() for ch in r.text or "")}
        if name == "near_dedup":
            pairs = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
            assert {r.doc_id for r in table.collect()} == set(slow_components(pairs))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in table.collect() for i in items)
    mixed = corpus_pipeline.mix_sources(spark, table, sf)
    taken = collections.Counter(r.doc_id for r in mixed.collect())
    expected = {r.doc_id: r.taken // r.size for r in mixing.op7_mixing(table).collect() if r.taken}
    assert taken == expected
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "shard", "slot"] and collections.Counter(r.doc_id for r in out.collect()) == taken
