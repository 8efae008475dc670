"""Operators of a training-data pipeline: packing, mixing, near duplicates, language ID and the rest."""
