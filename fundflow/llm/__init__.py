"""Training-data operators: quality, filtering, dedup, tokenization, packing.

One module per operator.  Nothing else in the library imports this package;
the registered queries are in ``queries``.
"""
