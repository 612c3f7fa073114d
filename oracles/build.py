"""Assemble each oracle query: its SELECT plus the common table expressions it mentions."""

from __future__ import annotations

import re

from oracles import checks, layers, raw
from oracles.tables import analysis, marts, staging

NAMED = {**raw.TABLES, **staging.TABLES, **marts.TABLES, **analysis.TABLES}
WORD = re.compile(r"\b[a-z_][a-z_0-9]*\b")


def _mentioned(sql: str) -> list[str]:
    words = set(WORD.findall(sql))
    return [name for name in NAMED if name in words]


def with_tables(select: str) -> str:
    """Prefix ``select`` with every named table it needs, directly or through another one."""
    needed: set[str] = set()
    todo = _mentioned(select)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [n for n in _mentioned(NAMED[name]) if n != name]
    if not needed:
        return select
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in NAMED.items() if name in needed)
    return f"WITH {ctes}\n{select}"


def oracle_queries() -> dict[str, str]:
    return {name: with_tables(sql) for name, sql in {**layers.QUERIES, **checks.QUERIES}.items()}
