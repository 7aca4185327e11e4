"""Operations of a training-data pipeline: archive writing, filters, dedup, packing.

Nothing else in the library imports this subpackage.
"""
