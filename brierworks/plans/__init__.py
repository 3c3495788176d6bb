"""Bindings of the operators to concrete tables, with their SQL twins."""
