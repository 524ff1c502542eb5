"""Registration of queries and the SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query of (spark, sf_dir), with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: The network that the driver's tables give: nations are nodes, modular rules give edges, times and stress levels.
NET = """
nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS region FROM nation),
edges AS (SELECT i.id AS src, j.id AS dst, 3 + (i.id * 31 + j.id * 17) % 7 AS time, 1 + (i.id + 2 * j.id) % 4 AS lts
          FROM nodes i, nodes j WHERE i.id <> j.id AND (i.id * 7 + j.id * 13) % 25 < 3),
pot AS (SELECT n.id AS node, (SELECT count(*) FROM customer WHERE c_nationkey = n.id) AS population,
               (SELECT count(*) FROM supplier WHERE s_nationkey = n.id) AS job FROM nodes n),
pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE lts > 2),
projects AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS proj, a, b FROM pairs),
project_edges AS (SELECT p.proj, e.src, e.dst, e.time FROM edges e JOIN projects p ON least(e.src, e.dst) = p.a AND greatest(e.src, e.dst) = p.b WHERE e.lts > 2),
cur AS (SELECT src, dst, time FROM edges WHERE lts <= 2)"""


def reach(name: str, edges: str, cutoff: int) -> str:
    return f"""
{name}_r AS (SELECT id AS orig, id AS node, CAST(0 AS BIGINT) AS dist FROM nodes
  UNION SELECT r.orig, e.dst, r.dist + e.time FROM {name}_r r JOIN {edges} e ON r.node = e.src WHERE r.dist + e.time <= {cutoff}),
{name} AS (SELECT orig, node, min(dist) AS dist FROM {name}_r GROUP BY orig, node)"""


#: Origin-destination pairs: reachable within 20 on the whole network, but not within 15 on the current one.
OD = reach("whole", "edges", 20) + "," + reach("now", "cur", 15) + """,
od AS (SELECT row_number() OVER (ORDER BY w.orig, w.node) AS od_id, w.orig, w.node AS des, w.dist AS time
       FROM whole w LEFT JOIN now n ON w.orig = n.orig AND w.node = n.node WHERE w.orig <> w.node AND n.orig IS NULL)"""


def with_net(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",".join([NET, *parts]) + body
