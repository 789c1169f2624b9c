"""Training-data operators: deduplication, search, scoring, packing, mixing and token files.

Nothing else in the library imports this subpackage.
"""
