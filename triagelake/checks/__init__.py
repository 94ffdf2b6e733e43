"""Checks of the operators on the given tables against independent SQL."""
