"""Readers and writers of question, answer, feature, metric and ledger tables."""
