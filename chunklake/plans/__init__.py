"""Registered queries: how the operators are put together over concrete tables."""
