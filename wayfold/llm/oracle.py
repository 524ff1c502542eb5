"""The same queries as SQL, where SQL can express them."""

from __future__ import annotations

P4_FOUND = """
WITH usable AS (
  SELECT rec_id, ins_id, budget, round(size, 6) AS size, obj, loaded_at FROM complete_pmedian_knn
  WHERE budget IS NOT NULL AND size IS NOT NULL AND obj IS NOT NULL AND isfinite(obj)),
in_use AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC, ins_id DESC, budget DESC, size DESC, obj DESC) = 1)
SELECT rec_id, CAST(place AS INTEGER) AS place FROM (
  SELECT rec_id, row_number() OVER (PARTITION BY ins_id, budget, size ORDER BY obj DESC, rec_id) AS place FROM in_use) WHERE place <= 3
"""

VECTORS = """
WITH RECURSIVE ok AS (
  SELECT od_id, feature, loaded_at FROM embedding WHERE feature IS NOT NULL AND len(feature) = 32
  AND len(list_filter(feature, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(feature, lambda x: x <> 0)) > 0),
v AS (SELECT od_id, feature FROM ok QUALIFY row_number() OVER (PARTITION BY od_id ORDER BY loaded_at DESC, feature DESC) = 1),
sim AS (SELECT a.od_id AS a, b.od_id AS b, round(list_cosine_similarity(a.feature, b.feature), 6) AS c FROM v a JOIN v b ON a.od_id < b.od_id),
link AS (SELECT a, b, c FROM sim WHERE c >= 0.95 UNION ALL SELECT b, a, c FROM sim WHERE c >= 0.95)"""

P2_FOUND = VECTORS + """,
met AS (SELECT od_id AS node, od_id AS label FROM v UNION SELECT l.b, m.label FROM met m JOIN link l ON l.a = m.node),
first AS (SELECT node, min(label) AS first_od, count(*) AS n FROM met GROUP BY node)
SELECT first_od, node AS od_id FROM first WHERE n >= 3
"""

#: Every pair in full; the graph finds the same neighbours at small sizes and nearly all at larger ones.
P3_FOUND = VECTORS + """,
near AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS place FROM link)
SELECT DISTINCT least(a, b) AS od_a, greatest(a, b) AS od_b FROM near WHERE place <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p3_found": P3_FOUND, "p4_found": P4_FOUND}
