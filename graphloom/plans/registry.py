"""A registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: CTEs that the SQL below shares: the graph made from the tables.
CTES = {
    "nodes": """nodes AS (
  SELECT 'paper:' || o_orderkey AS id, 'Paper' AS label, 'Order ' || o_orderkey AS name, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS field FROM orders
  UNION ALL SELECT 'topic:' || p_partkey, 'Topic', p_name, NULL, p_brand FROM part
  UNION ALL SELECT DISTINCT 'method:' || lower(replace(p_type, ' ', '-')), 'Method', p_type, NULL::INTEGER, NULL::VARCHAR FROM part
  UNION ALL SELECT 'dataset:' || s_suppkey, 'Dataset', s_name, NULL, NULL FROM supplier
  UNION ALL SELECT 'author:' || c_custkey, 'Author', c_name, NULL, c_mktsegment FROM customer
  UNION ALL SELECT 'institution:' || n_nationkey, 'Institution', n_name, NULL, NULL FROM nation)""",
    "edges": """edges AS (
  SELECT DISTINCT 'paper:' || l_orderkey AS src, 'topic:' || l_partkey AS dst, 'STUDIES' AS type FROM lineitem
  UNION ALL SELECT DISTINCT 'paper:' || l_orderkey, 'method:' || lower(replace(p_type, ' ', '-')), 'USES_METHOD' FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT DISTINCT 'paper:' || l_orderkey, 'dataset:' || l_suppkey, 'USES_DATASET' FROM lineitem
  UNION ALL SELECT DISTINCT 'author:' || o_custkey, 'paper:' || o_orderkey, 'AUTHORED' FROM orders
  UNION ALL SELECT DISTINCT 'author:' || c_custkey, 'institution:' || c_nationkey, 'AFFILIATED_WITH' FROM customer)""",
    "adj": """adj AS (SELECT src, dst, type FROM edges UNION ALL SELECT dst, src, type FROM edges)""",
    "studies": """studies AS (SELECT DISTINCT l_orderkey AS paper, l_partkey AS topic FROM lineitem)""",
    "related": """related AS (
  SELECT a.topic AS src, b.topic AS dst, count(*) AS shared FROM studies a JOIN studies b ON a.paper = b.paper AND a.topic < b.topic GROUP BY 1, 2 HAVING count(*) >= 2)""",
    "near": """near AS (SELECT src, dst FROM related UNION SELECT dst, src FROM related)""",
    "trade": """trade AS (
  SELECT cn.n_name AS src, sn.n_name AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY 1, 2)""",
    "brands": """brands AS (SELECT DISTINCT l_orderkey AS paper, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey)""",
    "vecs": """vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label AS cluster FROM embeddings)""",
}
NEEDS = {"adj": ["edges"], "related": ["studies"], "near": ["related"]}


def with_(*names: str, recursive: bool = False) -> str:
    """The WITH clause of some shared CTEs and what they need; further CTEs follow a comma."""
    out: list[str] = []

    def add(n):
        for m in NEEDS.get(n, []):
            add(m)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTES[n] for n in out)


def query(sql: str | None = None, name: str | None = None):
    def wrap(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return wrap
