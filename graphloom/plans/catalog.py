"""All registered queries."""

from graphloom.plans import catalog_algorithms, catalog_concepts, catalog_graph, catalog_research, catalog_text, catalog_views  # noqa: F401
from graphloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
