"""Registration of queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: Shared beginnings of the SQL: the tokens of documents.
SQL_TOKENS = r"""w AS (SELECT doc_id, lang, source, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
toks AS (SELECT doc_id, lang, source, unnest(ws) AS token, unnest(range(len(ws))) AS idx FROM w)"""


def query(name: str, sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register
