"""All registered queries and, where SQL can state them, their check queries."""

from parley.catalog import labels, models, scores, tables, texts, threads, vectors

_MODULES = (threads, tables, labels, vectors, texts, scores, models)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: query for module in _MODULES for name, query in module.ORACLE.items()}
