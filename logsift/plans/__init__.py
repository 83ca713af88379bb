"""Queries over the test tables, each beside the SQL that says the same."""

from __future__ import annotations


def registered() -> tuple[dict, dict]:
    """All queries and their SQL, by name."""
    from logsift.plans import detectors, modelling, relational
    from logsift.plans.registry import QUERIES, SQL

    assert detectors and modelling and relational
    return QUERIES, SQL
