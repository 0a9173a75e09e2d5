"""Whole requests composed from operators, and the registered queries."""
