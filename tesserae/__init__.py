"""Conjunctive evaluation analytics as Spark plans."""
