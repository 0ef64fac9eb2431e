"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from vectide.llm import bpe, clusters, diverse, history, knn, mojibake, packing, termfreq, topn

_MODULES = [topn, termfreq, bpe, packing, knn, clusters, history, mojibake, diverse]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
