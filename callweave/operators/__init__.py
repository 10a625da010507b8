"""Operators on traces, graphs and result tables."""
