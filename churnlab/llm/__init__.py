"""Operators for preparing language-model training data.

Nothing else in the library imports this package; its queries are added
to the registry only where it can be imported.
"""
