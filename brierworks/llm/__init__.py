"""Operators for large training corpora: one module per operator, its queries in ``queries``."""
