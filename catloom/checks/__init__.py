"""Queries over the given tables, one per operator, with reference SQL."""

from importlib import import_module

MODULES = ("text_checks", "rule_checks", "join_checks", "resolve_checks", "stats_checks", "extract_checks")


def load_all() -> None:
    for module in MODULES:
        import_module(f"catloom.checks.{module}")
