"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports
it; ``queries.py`` holds the registered queries, ``oracle.py`` their SQL.
"""
