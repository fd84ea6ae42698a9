"""Operators for preparing training data: splitting, cleaning, de-duplication, encoding, leakage."""
