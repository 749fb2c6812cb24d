"""Cumulative heads over update batches."""
