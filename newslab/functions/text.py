"""Words, keywords and overlap of headlines."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from newslab.constants import STOP_WORDS


def stored_words(headline: Column) -> Column:
    """Words of a stored headline. Repeats and the empty strings at either end stay,
    because the size of the union counts them."""
    return F.split(F.lower(headline), "[^a-z0-9]+")


def word_array(words: list[str]) -> Column:
    """A constant array of words without spaces."""
    return F.split(F.lit(" ".join(words)), " ")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def keywords(text: Column) -> Column:
    """Distinct tokens in order of first use, without stop words and single characters.

    A set difference needs no lambda, so it folds to a constant for a literal query.
    """
    dropped = STOP_WORDS + list(string.ascii_lowercase + string.digits)
    return F.array_except(tokens(text), word_array(dropped))


def shared_words(words: Column, kw: Column) -> Column:
    return F.array_intersect(words, kw)


def all_words(words: Column, kw: Column) -> Column:
    return F.array_union(words, kw)


def shared_count(words: Column, kw: Column) -> Column:
    return F.size(shared_words(words, kw)).cast("long")


def jaccard(words: Column, kw: Column) -> Column:
    union_size = F.size(all_words(words, kw))
    return F.when(union_size == 0, 0.0).otherwise(
        F.size(shared_words(words, kw)).cast("double") / union_size
    )


def display_text(headline: Column) -> Column:
    return F.trim(F.translate(headline, "\n\r", "  "))


def ticker_key(text: Column) -> Column:
    return F.upper(F.trim(text))


def ticker_list(text: Column) -> Column:
    """``'aapl, ,tsla'`` to ``['AAPL', 'TSLA']``."""
    return F.filter(F.transform(F.split(text, ","), ticker_key), lambda t: t != "")
