"""Operators for training text: names, pieces, packing, leakage, language."""
