"""All queries over the driver's tables, and the same in DuckDB SQL."""

from narrascope.plans import corpus_queries, io_queries, model_queries, story_queries, text_queries, vector_queries

_PARTS = [vector_queries.query, text_queries.query, corpus_queries.query, story_queries.query, io_queries.query, model_queries.query]
QUERIES = {name: f for part in _PARTS for name, f in part.queries.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.sql.items()}
