"""Operators for preparing language-model training data at cluster scale.

Nothing outside this package imports it; its queries are registered through
``corvane.llm.queries`` when the package is present.
"""
