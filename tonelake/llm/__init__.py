"""Operators for preparing training data from large document tables."""
