"""A penalty for grovelling, capitulation and directed aggression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import casefold, found, let, squash

#: Phrases by kind, for casefolded text with straight apostrophes.
APOLOGY = r"\b(?:i(?: am|'m) sorry|i apologize|my apologies|forgive me|my mistake)\b"
INTENSE_APOLOGY = r"\b(?:(?:deeply|sincerely|profusely|terribly) (?:sorry|apologetic)|apologize (?:deeply|sincerely|profusely))\b"
CAPITULATION = (
    r"\b(?:whatever you say|i(?:'ll| will) just agree|you(?: are|'re) (?:completely|absolutely|totally) right|"
    r"i was (?:completely|absolutely|totally) wrong|(?:because|since) you (?:say|said|insist|insisted) so)\b"
)
INSULT = r"\b(?:idiot|stupid|ignorant|moron|ridiculous)\b"
DISMISSIVE = (
    r"\b(?:read (?:it|my (?:previous )?(?:answer|response)|the answer) again|as i (?:already )?said|stop arguing|"
    r"do not argue|don't argue)\b"
)
AGGRESSION = (
    r"\b(?:you(?: are|'re) (?:clearly|obviously|simply|completely) (?:wrong|mistaken|confused)|"
    r"you (?:clearly|obviously) (?:do not|don't) understand)\b"
)
PENALTY = -0.5


def tone_reward(response: Column) -> Column:
    """-0.5 for two apologies, an intense one, capitulation, insults, dismissal or directed aggression; else 0."""

    def of(text: Column) -> Column:
        bad = F.regexp_count(text, F.lit(APOLOGY)) >= 2
        for pattern in (INTENSE_APOLOGY, CAPITULATION, INSULT, DISMISSIVE, AGGRESSION):
            bad = bad | found(text, pattern)
        return F.when(bad, F.lit(PENALTY)).otherwise(F.lit(0.0))

    return let(squash(F.replace(casefold(F.coalesce(response, F.lit(""))), F.lit("’"), F.lit("'"))), of)
