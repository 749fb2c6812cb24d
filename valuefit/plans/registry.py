"""All registered queries of the library and their SQL."""

from importlib import import_module

MODULES = ["curation", "answering", "training", "evaluating", "checking", "streams"]


def _gather(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), what, {}).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
