"""All queries of the library's own operators, by name."""

from __future__ import annotations

from sparkquill.plans import model_queries, result_queries, score_queries, source_queries, stream_queries, token_queries

FLAGSHIP = "m0_unigram_code_length_by_lang"
MODULES = (token_queries, model_queries, result_queries, score_queries, source_queries, stream_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
