"""Operators that prepare training data: code and text filters, splits, overlaps, tokenization.

Nothing else in the library imports this subpackage."""
