"""Tokenising and answer normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is one of the marks . , ( ) ! ? ' or a run without marks, separators and
# ASCII whitespace; the 32 ASCII punctuation marks; the English articles.
TOKEN = "[.,()!?']|[^.,()!?';: \\t\\n\\r\\f\\x0B]+"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = "(?U)\\b(a|an|the)\\b"


def tokenize(text: Column) -> Column:
    """Lower-cased word tokens: double quotes dropped, ; and : and <br /> as spaces, . , ( ) ! ? ' kept apart."""
    t = F.replace(F.replace(F.lower(text), F.lit('"'), F.lit("")), F.lit("<br />"), F.lit(" "))
    return F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, articles as spaces, single spaces."""
    t = F.translate(F.lower(text), ASCII_PUNCTUATION, "")
    t = F.regexp_replace(t, ARTICLES, " ")
    return F.trim(F.regexp_replace(t, "(?U)\\s+", " "))
