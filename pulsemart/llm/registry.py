"""The queries of the corpus operators and their expected-result SQL."""

from __future__ import annotations

from pulsemart.llm import (
    bitplanes, boilerplate, cover_tree, exact_dedup, language, mixing, packing, quality, sharding, simhash, spelling, substrings, urls,
)

MODULES = [bitplanes, boilerplate, cover_tree, exact_dedup, language, mixing, packing, quality, sharding, simhash, spelling, substrings, urls]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
