"""Training-data operators: duplicates, quality, privacy, mixing, tokens, media.

Nothing outside this package imports it. `queries.py` registers one query for
each operator.
"""
