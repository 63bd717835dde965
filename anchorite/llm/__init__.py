"""Training-data operators: tokens, language, privacy, quality, duplicates, packing, sharding.

Nothing else in the library imports this subpackage.
"""
