"""Registry of queries and the common parts of their SQL twins (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_WORD = r"[\pL\pN]+(?:[-‑][\pL\pN]+)*"
#: Words of the documents: (doc_id, lang, source, word_no, word).
SQL_WORDS = rf"""words AS (SELECT doc_id, lang, source, i - 1 AS word_no, w[i] AS word
  FROM (SELECT doc_id, lang, source, w, unnest(range(1, len(w) + 1)) AS i
        FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '{_WORD}') AS w FROM documents)))"""
#: Sentences of the documents: (doc_id, lang, source, para_no, sent_no, sentence).
SQL_SENTENCES = r"""pars AS (SELECT doc_id, lang, source, i - 1 AS para_no, l[i] AS par
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, lang, source, string_split_regex(text, '\n+') AS l FROM documents))),
sentences AS (SELECT doc_id, lang, source, para_no, j - 1 AS sent_no, m[j] AS sentence
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM (SELECT doc_id, lang, source, para_no,
    string_split(regexp_replace(trim(regexp_replace(par, '\s+', ' ', 'g')), '([.!?…;:])\s+([«"(]?[\p{Lu}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS m FROM pars)))"""


def sql_key(text: str) -> str:
    return rf"trim(regexp_replace(replace(lower({text}), 'ё', 'е'), '[^\pL\pN_]+', ' ', 'g'))"


def sql_uniform(*parts: str) -> str:
    """Twin of ``md5_uniform``: the parts are SQL expressions, the first one the seed."""
    return f"((('0x' || left(md5(concat_ws('|', {', '.join(parts)})), 8))::BIGINT + 0.5) / 4294967296.0)"


def sql_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"
