"""Operators that prepare training data at corpus scale."""
