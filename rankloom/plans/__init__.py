"""The registered queries and their SQL."""

from __future__ import annotations


def registered() -> tuple[dict, dict]:
    from . import chat, entity, explain, extraction, matching, retrieval, texts, views

    queries, sql = {}, {}
    for m in (retrieval, matching, views, explain, chat, texts, entity, extraction):
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
