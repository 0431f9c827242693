"""What ``__spark_entry__`` adds when this subpackage is present."""

from . import queries, similarity_queries, text_queries, token_queries

_MODULES = (text_queries, similarity_queries, queries, token_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
