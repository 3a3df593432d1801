"""Registered queries and their SQL counterparts, one module per area."""

from __future__ import annotations

from importlib import import_module

AREAS = ["links", "graphs", "search", "safety", "policies", "talks", "edits", "chunks", "code", "shapes", "stores", "stored"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for area in AREAS:
        part = getattr(import_module(f"weftgraph.catalog.{area}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
