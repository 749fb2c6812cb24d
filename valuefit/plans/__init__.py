"""Registered queries: operators applied to whole tables, with SQL that says the same."""
