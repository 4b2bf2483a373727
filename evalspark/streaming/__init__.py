"""Evaluating replies as they arrive."""
