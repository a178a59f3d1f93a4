"""Registered queries and their SQL equivalents, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("urls_pages", "dom", "content", "facts", "robots_sitemaps", "structured", "rules", "rendered", "answers", "identity", "report", "events")


def _merged(name: str) -> dict:
    out: dict = {}
    for area in AREAS:
        out |= getattr(import_module(f"crawlight.queries.{area}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
