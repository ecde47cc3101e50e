"""Operators for preparing training text: counts, packing, filters, duplicates, search."""
