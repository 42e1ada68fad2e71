"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from gatehouse.plans import checks, matching, text, usage

MODULES = [text, usage, matching, checks]


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
