"""Whole jobs composed of the operators, and the catalogue of queries."""
