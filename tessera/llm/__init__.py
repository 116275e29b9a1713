"""Training-data operators: filters, classifiers, search, packing and deduplication.

Nothing outside this package imports it.  Each module holds one operator with a
general DataFrame interface; ``queries`` holds the thin registered queries.
"""
