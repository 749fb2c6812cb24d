"""Operators on question, answer, feature and evaluation tables."""
