"""Training-data operators. ``queries`` and ``oracle_sql`` list what ``__spark_entry__`` registers."""

from __future__ import annotations


def queries() -> dict:
    from sievegate.llm import registry

    return registry.queries()


def oracle_sql() -> dict:
    from sievegate.llm import registry

    return registry.oracle_sql()
