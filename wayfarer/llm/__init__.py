"""Training-data operators: deduplication, packing, counting, mixing and scoring.

Nothing else in the library imports this subpackage.
"""
