"""Operators of a training-data pipeline over the tables ``documents``,
``embeddings``, ``benchmark`` and ``labels``.

Nothing outside this folder imports it. ``queries`` holds the registered
queries and their DuckDB statements; each other module is one operator.
"""
