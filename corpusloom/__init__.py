"""Corpus preparation, features and evaluation as Spark jobs."""

from corpusloom.session import ship

__all__ = ["ship"]
