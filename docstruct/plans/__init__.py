"""Whole jobs built from the operators."""
