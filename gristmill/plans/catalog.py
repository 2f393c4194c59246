"""All queries by name, each with its SQL where there is one."""

from __future__ import annotations

from gristmill.plans import base, corpus, graphs, jobs, knowledge, retrieval, search  # noqa: F401  (they register their queries)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
