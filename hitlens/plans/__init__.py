"""Combinations of operators."""
