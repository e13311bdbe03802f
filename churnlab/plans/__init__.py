"""Composed query plans: the query catalog and the model workflow."""
