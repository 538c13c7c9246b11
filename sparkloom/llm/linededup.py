"""Near-duplicate lines by a deletion-neighbourhood join, native plan only.

A line counts in lower case, without blanks at its ends. Two lines match if they are equal, or if one character's change,
removal or insertion makes one the other and that is at most a fifth of the longer line. A line goes if an earlier line
matches it; order is by document id (nulls last) and place. Blank lines always stay.

The neighbourhood of a whole line would be a variant as long as the line for each of its characters. An edit leaves all of
a line but one of its segments as it is, so lines are first joined by what is left without a segment, of which a line of n
characters has about the root of n, and only the segments of lines that share that emit variants: its key and the segment
without one character, hashed. Equal variants are joined, and the lines' edit distance is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import durable, text_or_empty, tmp

SHORTEST = 4  # characters of a line that can match another but equal one: a fifth of five is one edit
SHARE = 5  # an edit is at most one in so many characters
BLANKS = " \t\r\x0b\x0c"
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 64  # of a few longs in a broadcast table
NONE, ID, HASH, POS, LINE, H1, H2, GONE = (tmp(x) for x in ("none", "id", "hash", "pos", "line", "h1", "h2", "gone"))
FIRST = (NONE, ID, HASH, POS)


def _lines(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """A row for each line that isn't blank: its place, its normal form and two independent hashes of that."""
    text = text_or_empty(F.col(text_col))
    split = df.select(
        F.col(id_col).isNull().alias(NONE), F.col(id_col).alias(ID), F.xxhash64(text).alias(HASH),
        F.posexplode(F.split(text, "\n")).alias(POS, "raw"))
    norm = split.select(NONE, ID, HASH, POS, F.lower(F.btrim(F.col("raw"), F.lit(BLANKS))).alias(LINE)).where(F.col(LINE) != "")
    return norm.withColumns({H1: F.xxhash64(LINE), H2: F.xxhash64(F.lit(7), F.col(LINE))})


def _rest(line: Column, length: Column, j: Column, segments: Column) -> tuple[Column, Column, Column]:
    """(hash of the line without its segment j, first and last of that) as of a line of length characters: what is left of
    the segment is counted from the line's start, what is right of it from its end. So a line one character longer has
    the rest of a line of that length, and its own segment is one longer."""
    lo, hi = (F.floor(length * x / segments).cast("int") for x in (j, j + 1))
    right = length - hi
    return F.xxhash64(length, j, F.substring(line, F.lit(1), lo), F.right(line, right)), lo, right


def _halves(line: str, n: Column) -> Column:
    """Hashes of each half, as of its own length and of one less; two lines that match have one in common."""
    return F.array(*(_rest(F.col(line), length, F.lit(j), F.lit(2))[0] for length in (n, n - 1) for j in (0, 1)))


def _shared(keys: DataFrame) -> DataFrame:
    """Of (key, H1, ...) the keys that more than one distinct line has."""
    return keys.groupBy("key").agg(F.min(H1).alias("a"), F.max(H1).alias("b")).where("a <> b").select("key")


def _small(df: DataFrame) -> DataFrame:
    """A written table of a few longs a row, to be broadcast if its size allows."""
    df = durable(df)
    return F.broadcast(df) if df.count() * ROW_BYTES <= BROADCAST_BYTES else df


def _parts(whole: DataFrame) -> DataFrame:
    """length, j, key, lo, right: what is left of each line without each of its segments, as of its own length and of one less."""
    n = F.col("n")
    cut = whole.select(H1, H2, LINE, "n", F.explode(F.array(n, n - 1)).alias("length")).withColumn("segments", F.ceil(F.sqrt("length")).cast("int"))
    each = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
    key, lo, right = _rest(F.col(LINE), F.col("length"), F.col("j"), F.col("segments"))
    return each.select(H1, H2, "length", key.alias("key"), lo.alias("lo"), right.alias("right"))


def _variants(segments: DataFrame) -> DataFrame:
    """at 0: the whole segment, of a line of its key's length; at i: the segment without its i-th character; with the
    key, hashed twice. long: the line is one longer than its key's length."""
    long, size = F.col("n") > F.col("length"), F.col("n") - F.col("lo") - F.col("right")
    cut = segments.select("ord", "key", long.alias("long"), F.substring(F.col(LINE), F.col("lo") + 1, size).alias("part"), size.alias("size"))
    each = cut.withColumn("at", F.explode(F.sequence(F.col("long").cast("int"), F.col("size"))))
    left, right = F.substring("part", F.lit(1), F.col("at") - 1), F.right(F.col("part"), F.col("size") - F.col("at"))
    without = F.when(F.col("at") == 0, F.col("part")).otherwise(F.concat(left, right))
    return each.select("ord", "long", "at", F.xxhash64("key", without).alias("variant"), F.hash(without, "key").alias("check"))


def near_lines(lines: DataFrame, slim: DataFrame) -> DataFrame:
    """H1, H2 of the distinct lines that have an earlier near match.

    Lines that share a half, and of these such that are equal but for a segment, emit variants; the filters lose no
    match. In a group of equal variants each line looks at the earliest only, which is enough: lines of equal length
    without the same character are all within one edit of each other, and a group has at most one whole line, within one
    edit of all others. So a group's work is in proportion to its size. ord numbers lines in the order of their first
    place."""
    halves = slim.where(F.col("halves").isNotNull()).select(H1, H2, F.explode("halves").alias("key"))
    some = _small(halves.join(_small(_shared(halves)), "key", "left_semi").select(H1, H2).distinct())
    found = lines.join(some, [H1, H2], "left_semi").groupBy(H1, H2).agg(F.min(F.struct(*FIRST)).alias("first"), F.first(LINE).alias(LINE))
    whole = durable(found.withColumn("n", F.length(LINE)))
    parts = _parts(whole)
    close = durable(parts.join(_small(_shared(parts)), "key", "left_semi"))
    order = [F.col(f"first.{c}") for c in FIRST]
    chosen = whole.join(_small(close.select(H1, H2).distinct()), [H1, H2], "left_semi")
    chosen = durable(chosen.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id()))
    variants = durable(_variants(close.join(chosen, [H1, H2])))  # read four times
    cut, group = variants.where("at > 0"), ["variant", "check"]
    swapped = cut.where("not long").groupBy(*group, "at").agg(F.min("ord").alias("other"), F.max("ord").alias("last")).where("other < last").drop("last")
    length = variants.groupBy(*group).agg(F.min(F.when(F.col("at") == 0, F.col("ord"))).alias("whole"), F.min(F.when(F.col("long"), F.col("ord"))).alias("cut")).where("whole is not null and cut is not null")
    by_swap = cut.where("not long").join(swapped, [*group, "at"]).select("ord", "other")
    by_length = variants.where("long or at = 0").join(length, group).select("ord", F.when(F.col("at") == 0, F.col("cut")).otherwise(F.col("whole")).alias("other"))
    pairs = by_swap.unionAll(by_length).where("other < ord").distinct()
    a, b = chosen.select("ord", H1, H2, LINE), chosen.select(F.col("ord").alias("other"), F.col(LINE).alias("others"))
    both = pairs.join(a, "ord").join(b, "other")
    edits = F.levenshtein(F.col(LINE), F.col("others"), 1)
    return both.where((edits >= 0) & (edits * SHARE <= F.greatest(F.length(LINE), F.length("others")))).select(H1, H2).distinct()


def dedup_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with the lines that an earlier line matches taken out of its text, and lines and kept (their numbers).

    Null text: stays null, no lines. Null ids come last. Lines and texts of any length. Rows equal in id and text are one document: each of them keeps
    the lines that it would keep alone. A text all of whose lines go is empty. Empty table: empty result. Columns of df
    named lines or kept are replaced."""
    lines = _lines(df, text_col, id_col)
    counted = lines.withColumn("n", F.length(LINE))
    slim = durable(counted.select(*FIRST, H1, H2, F.when(F.col("n") >= SHORTEST, _halves(LINE, F.col("n"))).alias("halves")))
    near = _small(near_lines(lines, slim))
    here = slim.select(H1, H2, F.struct(*FIRST).alias("here"))
    again = _small(here.groupBy(H1, H2).agg(F.min("here").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"))
    later = here.join(near, [H1, H2], "left_semi").select("here").unionAll(here.join(again, [H1, H2]).where(F.col("here") != F.col("first")).select("here"))
    gone = later.select("here.*").groupBy(NONE, ID, HASH).agg(F.collect_set(POS).alias(GONE))
    own = [c for c in df.columns if c not in ("lines", "kept")]
    keyed = df.select(*own, F.col(id_col).isNull().alias(NONE), F.col(id_col).alias(ID), F.xxhash64(text_or_empty(F.col(text_col))).alias(HASH))
    joined = keyed.join(gone, [keyed[NONE] == gone[NONE], keyed[ID].eqNullSafe(gone[ID]), keyed[HASH] == gone[HASH]], "left").select(*(keyed[c] for c in own), gone[GONE])
    split = F.split(F.col(text_col).cast("string"), "\n")
    kept = F.when(F.col(GONE).isNull(), split).otherwise(F.filter(split, lambda x, i: ~F.array_contains(GONE, i)))
    out = joined.withColumns({LINE: kept, "lines": F.coalesce(F.size(split), F.lit(0))})
    out = out.withColumns({"kept": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(LINE)), text_col: F.array_join(LINE, "\n")})
    return out.select(*own, F.greatest("lines", F.lit(0)).cast("long").alias("lines"), F.col("kept").cast("long").alias("kept"))


def op4_line_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, lines, kept and the MD5 of the text that stays, of all documents."""
    return dedup_lines(documents.select("doc_id", "text")).select("doc_id", "lines", "kept", F.md5(F.col("text")).alias("kept_md5"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, pos, lower(trim(string_split(text, chr(10))[pos], ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
), classes AS (
  SELECT line, len(line) AS n, min((doc_id, pos)) AS first, row_number() OVER () AS id FROM lines WHERE line <> '' GROUP BY line
), lengths AS (
  SELECT *, unnest([n, n - 1]) AS length FROM classes WHERE n >= 4
), halves AS (
  SELECT id, n, line, first, unnest([hash(length, 'l', left(line, length // 2)), hash(length, 'r', right(line, length - length // 2))]) AS half FROM lengths
), pairs AS (
  SELECT DISTINCT a.id, CASE WHEN a.n <= b.n THEN a.line ELSE b.line END AS short, CASE WHEN a.n <= b.n THEN b.line ELSE a.line END AS long
  FROM halves a JOIN halves b ON a.half = b.half AND b.first < a.first AND abs(a.n - b.n) <= 1 AND greatest(a.n, b.n) >= 5
), letters AS (
  SELECT id, string_split(short, '') AS s, string_split(long, '') AS l FROM pairs
), near AS (
  SELECT DISTINCT id FROM (SELECT *, coalesce(list_position(list_transform(list_zip(s, l), lambda x: x[1] IS DISTINCT FROM x[2]), true), len(s) + 1) AS p FROM letters)
  WHERE s[p + CASE WHEN len(s) = len(l) THEN 1 ELSE 0 END:] = l[p + 1:]
), judged AS (
  SELECT l.doc_id, l.pos, l.line = '' OR (c.first = (l.doc_id, l.pos) AND n.id IS NULL) AS stays
  FROM lines l LEFT JOIN classes c USING (line) LEFT JOIN near n ON n.id = c.id
), shown AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
)
SELECT s.doc_id, len(any_value(s.parts)) AS lines, count(*) FILTER (j.stays) AS kept,
  md5(coalesce(string_agg(s.parts[j.pos], chr(10) ORDER BY j.pos) FILTER (j.stays), '')) AS kept_md5
FROM shown s JOIN judged j USING (doc_id) GROUP BY s.doc_id
"""
