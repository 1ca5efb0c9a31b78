"""Operators for preparing language-model training corpora at cluster scale.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""
