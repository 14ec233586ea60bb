"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. `queries.QUERIES` holds the named
queries, `queries.ORACLES` their SQL where SQL can say it.
"""
