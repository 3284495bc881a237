"""Text functions as column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.lexicons import ABBREVIATIONS, STOP_WORDS

# What counts as a word and as a number.
WORD = r"(?U)\b[a-zA-Z]+(?:'[a-zA-Z]+)?\b"
NUMBER = r"\$[\d,.]+|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+%|\d+%"
_AB = "|".join(ABBREVIATIONS)
NAIVE_BREAK = r"(?U)(?<=[.!?])\s+(?=[A-Z])"
BREAK = rf"(?U)(?<=[.!?])(?<!(?:{_AB})\.)(?<![A-Z]\.[A-Z]\.)\s+(?=[A-Z])(?!(?:{_AB})\.)(?![A-Z]\.[A-Z]\.)"


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Words of ASCII letters in lower case; null texts give null."""
    return F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lower)


def content_tokens(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: ~t.isin(STOP_WORDS))


def _pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), stripped), lambda s: s != "")


def naive_sentences(c: Column) -> Column:
    return _pieces(c, NAIVE_BREAK)


def sentences(c: Column) -> Column:
    """Sentences that no abbreviation or initials break."""
    return _pieces(c, BREAK)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by a blank; none if there are fewer words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def syllables(word: Column) -> Column:
    groups = F.greatest(F.regexp_count(word, F.lit("[aeiouy]+")), F.lit(1))
    return groups - F.when(word.endswith("e") & (groups > 1), 1).otherwise(0)


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(otherwise))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def readability(words: Column, sents: Column) -> dict[str, Column]:
    """Density and indices of one text, from columns that hold its words and its sentences."""
    n_words, n_sents = F.size(words), F.size(sents)
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    complex_ = F.size(F.filter(words, lambda w: syllables(w) >= 3))
    none = words.isNull() | (n_words <= 0) | (n_sents <= 0)
    fog = 0.4 * (ratio(n_words, n_sents) + 100 * ratio(complex_, n_words))
    coleman = 0.0588 * (100 * ratio(letters, n_words)) - 0.296 * (100 * ratio(n_sents, n_words)) - 15.8
    return {
        "density": F.when(none, 0.0).otherwise(ratio(F.size(F.array_distinct(words)), n_sents)),
        "fog": F.when(none, 0.0).otherwise(fog),
        "coleman": F.when(none, 0.0).otherwise(coleman),
    }
