"""Text clean-up and token functions: plain column expressions, no UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.hashing import _col
from labelloom.functions.stopwords import ENGLISH

# The clean-up patterns that decide the result.  Punctuation is all
# but word characters, digits and white space; \w covers digits, and naming \d as
# well would double the matching time.
PUNCTUATION = r"[^\w\s]"
SPACE_RUN = " +"
# Fixed value: the same rule for all alphabets, where \w would be ASCII only.
PUNCTUATION_UNICODE = r"[^\p{L}\p{N}_\s]"
# Fixed value: token separator.
WHITESPACE = r"\s+"


def _pattern(unicode: bool) -> str:
    return PUNCTUATION_UNICODE if unicode else PUNCTUATION


def clean_text(text: Column | str, unicode: bool = False) -> Column:
    """Lower-case, drop punctuation, collapse runs of spaces, trim."""
    bare = F.regexp_replace(F.trim(F.lower(_col(text))), _pattern(unicode), "")
    return F.trim(F.regexp_replace(bare, SPACE_RUN, " "))


def tokenize(text: Column | str) -> Column:
    """Split at white space; empty pieces are dropped."""
    return F.filter(F.split(_col(text), WHITESPACE), lambda t: t != "")


def normalize_tokens(tokens: Column | str, unicode: bool = False) -> Column:
    """Lower-case every token and strip its punctuation; drop what gets empty."""
    bare = F.transform(_col(tokens),
                       lambda t: F.regexp_replace(F.lower(t), _pattern(unicode), ""))
    return F.filter(bare, lambda t: t != "")


def remove_stopwords(tokens: Column | str, stopwords: Sequence[str] = ENGLISH) -> Column:
    """Drop stop words, ignoring case; other tokens keep order and repeats.

    ``isin`` over literals becomes one hash-set probe per token.
    """
    words = sorted({w.lower() for w in stopwords})
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~F.lower(t).isin(words))


def normalized_tokens(text: Column | str, unicode: bool = False) -> Column:
    """``normalize_tokens(tokenize(text))`` with one regex pass per text.

    The pattern never touches white space, so stripping the whole text first
    and splitting afterwards gives the same tokens.
    """
    return tokenize(F.regexp_replace(F.lower(_col(text)), _pattern(unicode), ""))


def clean_tokens(text: Column | str, stopwords: Sequence[str] = ENGLISH,
                 unicode: bool = False) -> Column:
    """The token chain without a lemma dictionary, as a single expression.

    Equals ``remove_stopwords(normalize_tokens(tokenize(text)))`` with one regex
    pass per text and one test per token.
    """
    bare = F.regexp_replace(F.lower(_col(text)), _pattern(unicode), "")
    drop = ["", *sorted({w.lower() for w in stopwords})]
    return F.filter(F.split(bare, WHITESPACE), lambda t: ~t.isin(drop))


def is_nonempty(tokens: Column | str) -> Column:
    """False for [], [''] and [null], null for null; true for anything else.

    The argument occurs once: Spark moves filters below projections and would
    evaluate a costly token expression once per mention.
    """
    return F.array_join(_col(tokens), ",", "") != ""
