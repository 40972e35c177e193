"""Operators that prepare training data. Nothing else in silkweb imports this subpackage."""
