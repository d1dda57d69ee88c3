"""Tokens of texts as Catalyst expressions: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = ("ing", "ed", "ly", "es", "s", "er", "or")
LONGEST = 255


def stem(word: Column) -> Column:
    """Drops the first suffix that fits; a stem under 3 letters keeps the word; of a doubled last letter one goes."""
    cut = F.lit(0)
    for s in reversed(SUFFIXES):
        cut = F.when(word.endswith(s), F.lit(len(s))).otherwise(cut)
    size = F.length(word) - cut
    root = F.substring(word, F.lit(1), size)
    doubled = (F.substring(word, size, F.lit(1)) == F.substring(word, size - 1, F.lit(1))) & F.substring(word, size, F.lit(1)).rlike("[a-z]")
    short = F.substring(word, F.lit(1), size - 1)
    return F.when((cut == 0) | (size < 3), word).when(doubled, short).otherwise(root)


def tokens(text: Column, stemming: bool = False, stopwords: list[str] | None = None) -> Column:
    """Array of tokens: runs of ASCII letters, digits and apostrophes, lower-cased; stop words go before stemming,
    tokens under two bytes after it.  Positions are places in the array."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    # One expression cuts words, drops short ones and what is beyond the longest: no function runs for each word.
    least = 1 if stemming else 2
    words = F.regexp_extract_all(lower, F.lit(f"([a-z0-9']{{{least},{LONGEST}}})[a-z0-9']*"), F.lit(1))
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(*stopwords))
    return F.filter(F.transform(words, stem), lambda w: F.length(w) >= 2) if stemming else words
