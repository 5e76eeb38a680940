"""Training-data operators: tokenising, quality, dedup, filtering, mixing.

Each module holds one operator with a general interface; ``queries`` wraps
them as the registered ``opN_*`` queries.  Nothing else in the library
imports this package.
"""
