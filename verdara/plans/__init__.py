"""Workflows made of the operators, and their bindings to the test tables."""
