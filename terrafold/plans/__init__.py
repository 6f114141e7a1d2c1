"""Queries and their views; the catalogue comes first, whichever module is asked for."""

from terrafold.plans import catalogue  # noqa: F401
