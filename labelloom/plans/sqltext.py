"""Fragments shared by the reference SQL of several queries (DuckDB dialect)."""

from __future__ import annotations

from labelloom.functions.stopwords import ENGLISH


def digest(row_id: str, seed: int | str = 42) -> str:
    return f"md5('{seed}:' || CAST({row_id} AS VARCHAR))"


def hash32(row_id: str, seed: int | str = 42) -> str:
    return f"CAST(('0x' || substr({digest(row_id, seed)}, 1, 8)) AS BIGINT)"


def bucket(row_id: str, n: int, seed: int | str = 42) -> str:
    return f"({hash32(row_id, seed)} % {n})"


def clean(text: str, pattern: str = r"[^\w\d\s]") -> str:
    return (f"trim(regexp_replace(regexp_replace(trim(lower({text})), '{pattern}', '', 'g'), "
            f"' +', ' ', 'g'))")


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda t : t <> '')"


def normalized(text: str) -> str:
    return (f"list_filter(list_transform({tokens(text)}, "
            r"lambda t : regexp_replace(lower(t), '[^\w\d\s]', '', 'g')), lambda t : t <> '')")


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def without_stopwords(tokens_sql: str, words=ENGLISH) -> str:
    return f"list_filter({tokens_sql}, lambda t : lower(t) NOT IN ({quoted(words)}))"


def clean_tokens(text: str) -> str:
    return without_stopwords(normalized(text))


def lemmatized(tokens_sql: str) -> str:
    """With the stand-in dictionary of ``inputs.suffix_dictionary``."""
    return (f"list_transform({tokens_sql}, lambda t : "
            "CASE WHEN regexp_matches(t, '^.{3,}ing$') THEN substr(t, 1, length(t) - 3) ELSE t END)")


def lemma_tokens(text: str) -> str:
    return without_stopwords(lemmatized(normalized(text)))
