"""DuckDB oracle SQL for scans and sinks (§2.1): what the written files must hold."""

from __future__ import annotations

from concourse.oracle.serving import ORACLE as SERVING
from concourse.oracle.serving import base_ctes, lounges_sql

_PER_AIRPORT = f"""
WITH lounges AS ({lounges_sql()}),
airports AS (
  SELECT 'A' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS airport_code FROM nation
  UNION ALL
  SELECT 'R' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0') FROM region)
SELECT a.airport_code, CAST(count(l.lounge_id) AS BIGINT) AS n_lounges{{extra}}
FROM airports a LEFT JOIN lounges l ON l.airport_code = a.airport_code
GROUP BY a.airport_code"""

ORACLE = {
    "scan_pages": "SELECT page_id, url, html FROM pages",
    "scan_catalog_json": f"""
        WITH lounges AS ({lounges_sql()})
        SELECT airport_code, lounge_id, amenities, array_to_string(conditions, '|') AS conditions_text
        FROM lounges""",
    "write_ndjson": _PER_AIRPORT.format(
        extra=", CAST(count(l.lounge_id) FILTER (WHERE l.amenities IS NULL) AS BIGINT) AS n_null_amenities"),
    # cards without a link or a heading are not stored
    "load_catalog_overwrite": _PER_AIRPORT.format(extra="").replace(
        "LEFT JOIN lounges l ON", "LEFT JOIN (SELECT * FROM lounges WHERE k % 29 <> 0 AND k % 23 <> 0) l ON"),
    "incremental_publish": _PER_AIRPORT.format(extra=""),
    "sink_advisory_json": base_ctes("supplier") + """
        , nrec AS (SELECT pass_id, CAST(count(*) AS INTEGER) AS n FROM top5 GROUP BY pass_id)
        SELECT c.pass_id, coalesce(n.n, 0) AS n_recommendations, c.window_status = 'open' AS has_window
        FROM ctx2 c LEFT JOIN nrec n ON n.pass_id = c.pass_id""",
}
assert "recommend_batch" in SERVING
