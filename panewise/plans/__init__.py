"""The registered queries and, next to each, the same question in plain SQL."""

from panewise.plans import inputs, joins, outputs, relational, streams, windows

MODULES = (relational, windows, joins, inputs, outputs, streams)


def all_queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql():
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
