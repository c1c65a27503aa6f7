"""Training-data operators: mixing, deduplication, tokenisation, filters, search.

Nothing else in the library imports this subpackage.
"""
