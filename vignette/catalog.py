"""All queries of the engine and the SQL that expresses them."""

from __future__ import annotations

from .queries import evaluation, formats, graph, mining, parsing, search  # noqa: F401
from .queries.registry import ORACLES, QUERIES, Query

FLAGSHIP = "a2_search_movies"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
