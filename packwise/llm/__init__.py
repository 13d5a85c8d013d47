"""Operators for large text collections used as training data. Nothing outside this folder imports it."""
