"""Every registered query with its SQL twin."""

from __future__ import annotations

from . import filed, models, networks, relational, statistics

_MODULES = (relational, statistics, networks, filed, models)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
