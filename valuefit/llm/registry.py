"""Queries of the corpus operators and their SQL."""

from importlib import import_module

MODULES = ["url_filter", "line_dedup", "decontaminate", "multi_index", "quality", "pieces", "minhash", "toxicity", "license_scan", "pii", "html_text", "centroids", "whitening"]


def _gather(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), what, {}).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
