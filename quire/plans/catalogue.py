"""All queries of the library proper, by name, and their SQL."""

from __future__ import annotations

from . import geometry, layout, more, pages, rules, tasks, text

_ALL = {**geometry.QUERIES, **text.QUERIES, **layout.QUERIES, **tasks.QUERIES, **pages.QUERIES, **more.QUERIES, **rules.QUERIES}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
