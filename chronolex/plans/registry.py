"""Collects the queries of all plan modules."""

from __future__ import annotations

from chronolex.plans import catalog, drafting, evidence, graph, impacts, maintenance, mirror, quotes, references, search, serving, streams, text, units, versions


def queries() -> dict[str, catalog.Query]:
    assert all((drafting, evidence, graph, impacts, maintenance, mirror, quotes, references, search, serving, streams, text, units, versions))
    return catalog.QUERIES


def oracle_sql() -> dict[str, str]:
    return catalog.ORACLES
