"""Training-data operators: quality, de-duplication, archives, scoring, mixing.

Nothing else in the library imports this subpackage.
"""
