"""Text expressions that agree with the usual Unicode rules of strip, split, casefold and regular expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: Java's Unicode class lacks the four information separators.
WS = r"[\s\x1c-\x1f]"
#: Case-insensitive, only \n ends lines, Unicode case and classes.
FLAGS = "(?imduU)"

#: What lower-casing leaves and casefolding expands.
FOLDS = {"ß": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ς": "σ"}

#: Words that tell prompts not apart.
STOPWORDS = (
    "about", "after", "answer", "based", "before", "choose", "claim", "following", "independently", "please", "reason",
    "reply", "short", "sentence", "should", "their", "there", "these", "think", "what", "which", "would", "your",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, however often body names it: the optimizer would else write an
    expression out wherever a field or a branch needs it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def casefold(c: Column) -> Column:
    out = F.lower(c)
    for old, new in FOLDS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+|{WS}+\z", "")


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def words(c: Column) -> Column:
    """Split at white space; empty text has none."""
    flat = squash(c)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 in the casefolded text."""
    return F.regexp_extract_all(casefold(c), F.lit("([a-z0-9]+)"), F.lit(1))


def content_tokens(c: Column) -> Column:
    """Tokens of four or more characters that aren't stop words, in order."""
    return F.filter(tokens(c), lambda t: (F.length(t) >= 4) & ~t.isin(*STOPWORDS))


def bigrams(toks: Column) -> Column:
    """Neighbouring tokens, joined by a space; none for fewer than two."""
    n = F.size(toks)
    pair = lambda i: F.concat_ws(" ", F.element_at(toks, i), F.element_at(toks, i + 1))
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), pair)).otherwise(F.array().cast("array<string>"))


def canonical(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def found(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def any_found(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | found(c, p)
    return out
