"""Text expressions, all evaluated inside the scan stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a "word character" is: letters and digits of any script, and the underscore.
WORD = r"[\p{L}\p{N}_]"

#: A run of anything but white space, white space of all scripts included.
NON_SPACE = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_words(text: str | Column) -> Column:
    """Whitespace tokens; a single space where the text is missing."""
    text = _col(text)
    words = F.regexp_extract_all(text, F.lit(NON_SPACE), F.lit(0))
    return F.when(text.isNull(), F.array(F.lit(" "))).otherwise(words)


def word_tokens(text: str | Column, chars: int = 3) -> Column:
    """Runs of at least ``chars`` word characters, in order."""
    return F.regexp_extract_all(_col(text), F.lit(f"{WORD}{{{int(chars)},}}"), F.lit(0))


def terms(text: str | Column, chars: int = 3) -> Column:
    """Lower-cased word tokens, the terms of the vector space."""
    return word_tokens(F.lower(_col(text)), chars)


def keep_word_tokens(text: str | Column, chars: int = 3) -> Column:
    """The word tokens joined by one space."""
    return F.array_join(word_tokens(text, chars), " ")


def collapse_double_space(text: str | Column) -> Column:
    """Two spaces become one, in one pass from the left (four become two)."""
    return F.regexp_replace(_col(text), "  ", " ")


def language_flag(lang: str | Column, base_lang: str) -> Column:
    """0.0 for the base language, 1.0 for any other, and for a missing one."""
    return F.when(_col(lang) == F.lit(base_lang), F.lit(0.0)).otherwise(F.lit(1.0))
