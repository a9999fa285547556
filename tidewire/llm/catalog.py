"""Names of the operators' queries and their SQL."""

from __future__ import annotations

from tidewire.llm import oracles
from tidewire.llm import queries as q


def queries():
    return {name: f for name, f in vars(q).items() if name.startswith("op")}


def oracle_sql():
    return dict(oracles.SQL)
