"""DuckDB oracle SQL for §2.4 (OCR output) and §2.5 (pass text).

The expected fields of a printed text are the fixture's own columns that the text was made of
(cities, times, gate, terminal), not patterns run over it."""

from __future__ import annotations

from concourse.oracle.serving import PASSES_SQL
from concourse.plans.fixtures import BARCODE_SQL, EDITS_SQL, JSON_TEXT_SQL, MODEL_TEXT_SQL

WS = r"'^\s+|\s+$', '', 'g'"

PASSES_EXT = PASSES_SQL.replace(
    "FROM events", ", 'XY' || CAST(event_id AS VARCHAR) AS flight_number,\n"
                   "      CASE WHEN event_id % 5 IN (0, 1, 4) THEN 'printed' END AS terminal_source\n    FROM events")

TEXT_CTES = f"""
WITH passes AS ({PASSES_EXT}),
cities AS (SELECT CAST(n_nationkey AS BIGINT) AS city_key, n_name AS city FROM nation),
made AS (
  SELECT p.*, CASE WHEN p.pass_id % 19 <> 7 THEN a.city END AS dep_city,
         CASE WHEN p.pass_id % 19 <> 7 THEN b.city END AS dest_city
  FROM passes p
  LEFT JOIN cities a ON a.city_key = p.user_id % 25
  LEFT JOIN cities b ON b.city_key = (p.user_id + 7) % 25),
printed AS (
  SELECT pass_id, dep_city, dest_city,
    CASE WHEN dep_city IS NULL THEN NULL WHEN pass_id % 4 = 3 THEN 'inferred' ELSE 'marked' END AS route_source,
    CASE WHEN pass_id % 2 = 0 THEN chr(CAST(65 + user_id % 25 AS INTEGER))
         || chr(CAST(65 + (user_id + 7) % 25 AS INTEGER)) || 'X' END AS dep_iata,
    CASE WHEN pass_id % 6 = 2 THEN 'QQZ' END AS dest_iata,
    CASE WHEN pass_id % 8 = 5 THEN strftime(now_ts, '%Y-%m-%d') || ' ' ELSE '' END || boarding AS boarding_time,
    departure AS departure_time,
    CASE WHEN pass_id % 3 = 1 THEN 'BER' ELSE 'XY' END || CAST(pass_id % 10000 AS VARCHAR) AS flight_number,
    CASE pass_id % 5 WHEN 2 THEN 'B12' WHEN 3 THEN '7' END AS gate,
    CASE WHEN pass_id % 5 = 2 THEN 'B' ELSE terminal END AS terminal_value,
    CASE WHEN terminal IS NOT NULL THEN 'printed' WHEN pass_id % 5 = 2 THEN 'inferred' END AS terminal_source
  FROM made),
pt AS (
  SELECT *,
    CAST(CASE route_source WHEN 'marked' THEN 1.0 WHEN 'inferred' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS route_confidence,
    CAST(CASE terminal_source WHEN 'printed' THEN 1.0 WHEN 'inferred' THEN 0.5 ELSE 0.0 END AS DOUBLE)
      AS terminal_confidence
  FROM printed)
"""

OCR_WORDS = """
WITH words AS (
  SELECT doc_id, unnest(string_split(line, ' ')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
conf AS (
  SELECT doc_id, avg(CAST((length(w) % 17) AS DOUBLE) / 16.0) AS ocr_confidence,
         CAST(count(*) AS INTEGER) AS n_words
  FROM words GROUP BY doc_id)
"""

_JSON_CHECKS = [
    ("NOT json_valid(json_text) OR json_type(json_text) <> 'OBJECT'", "not JSON"),
] + [(f"NOT list_contains(json_keys(json_text), '{k}')", f"missing {k}") for k in
     ["airport", "destination", "terminal", "gate", "flight_number", "departure_time_local",
      "boarding_time_local", "raw_text"]]
for _parent, _keys in [("airport", ["iata", "city"]), ("destination", ["iata", "city"]),
                       ("terminal", ["value", "source"])]:
    for _k in _keys:
        _JSON_CHECKS.append((f"NOT coalesce(list_contains(json_keys(json_text, '$.{_parent}'), '{_k}'), false)",
                             f"missing {_parent}.{_k}"))
        _JSON_CHECKS.append((f"json_type(json_text, '$.{_parent}.{_k}') NOT IN ('VARCHAR', 'NULL')",
                             f"{_parent}.{_k} is not a string"))
for _k in ["gate", "flight_number", "departure_time_local", "boarding_time_local", "raw_text"]:
    _JSON_CHECKS.append((f"json_type(json_text, '$.{_k}') NOT IN ('VARCHAR', 'NULL')", f"{_k} is not a string"))
for _parent in ["destination", "terminal"]:
    _t = f"json_type(json_text, '$.{_parent}.confidence')"
    _JSON_CHECKS.append((f"{_t} IS NOT NULL AND NOT ({_t} IN ('UBIGINT', 'BIGINT', 'DOUBLE') "
                         f"OR ({_t} = 'VARCHAR' AND TRY_CAST(json_extract_string(json_text, '$.{_parent}.confidence') "
                         f"AS DOUBLE) IS NOT NULL))", f"{_parent}.confidence is not a number"))
_A = "json_type(json_text, '$.assumptions')"
_JSON_CHECKS.append((f"{_A} IS NOT NULL AND ({_A} <> 'ARRAY' OR len(list_filter(json_transform(json_text, "
                     "'{\"assumptions\": [\"JSON\"]}').assumptions, lambda x: json_type(x) <> 'VARCHAR')) > 0)",
                     "assumptions is not an array of strings"))
_REASON = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in _JSON_CHECKS) + " END"

ORACLE = {
    "ocr_confidence": OCR_WORDS + "SELECT doc_id, ocr_confidence, n_words FROM conf",
    "ocr_language": "SELECT doc_id, coalesce(lang, 'unknown') AS language FROM documents",
    "confidence_gate": OCR_WORDS + "SELECT doc_id, ocr_confidence, ocr_confidence < 0.7 AS needs_manual_edit FROM conf",
    "barcode_candidate": f"""
        SELECT doc_id, CAST(length(raw) AS INTEGER) AS raw_length, md5(raw) AS raw_md5 FROM (
          SELECT doc_id, coalesce(
              nullif(regexp_replace(list_filter(string_split(text, chr(10)),
                       lambda e: contains(e, 'PDF417') OR length(e) > 60)[1], {WS}), ''),
              CASE WHEN length(text) > 60 THEN regexp_replace(text, {WS}) END) AS raw
          FROM documents)""",
    "bcbp_fields": f"""
        WITH b AS (SELECT o_orderkey AS order_key, {BARCODE_SQL} AS raw FROM orders),
        d AS (SELECT *, length(raw) >= 51 AND TRY_CAST(trim(substr(raw, 45, 3)) AS INTEGER) IS NOT NULL AS ok,
                     TRY_CAST(trim(substr(raw, 45, 3)) AS INTEGER) AS day FROM b)
        SELECT order_key, CAST(length(raw) AS INTEGER) AS raw_length,
          CASE WHEN ok THEN nullif(trim(substr(raw, 31, 3)), '') END AS airport_iata,
          CASE WHEN ok THEN nullif(trim(substr(raw, 34, 3)), '') END AS destination,
          CASE WHEN ok THEN nullif(trim(substr(raw, 37, 3)) || ltrim(trim(substr(raw, 40, 5)), '0'), '') END
            AS flight_number,
          CASE WHEN ok THEN strftime(DATE '2024-01-01' + (day - 1), '%Y-%m-%d') END AS date
        FROM d""",
    "strip_code_fence": f"""
        WITH passes AS ({PASSES_SQL}),
        m AS (SELECT pass_id, {MODEL_TEXT_SQL} AS text FROM passes),
        a AS (SELECT pass_id, text, regexp_replace(text, {WS}) AS t0 FROM m)
        SELECT pass_id,
          regexp_replace(regexp_replace(regexp_replace(regexp_replace(t0, '^```json\\s*', ''), '^```\\s*', ''),
                         '\\s*```$', ''), {WS}) AS anchored,
          CASE WHEN regexp_matches(text, '```(?:json)?\\s*([\\s\\S]*?)```')
               THEN regexp_replace(regexp_extract(text, '```(?:json)?\\s*([\\s\\S]*?)```', 1), {WS})
               ELSE regexp_replace(text, {WS}) END AS extracted
        FROM a""",
    "json_contract": f"""
        WITH passes AS ({PASSES_SQL}),
        j AS (SELECT pass_id, {JSON_TEXT_SQL} AS json_text FROM passes),
        r AS (SELECT pass_id, json_text, {_REASON} AS reject_reason FROM j)
        SELECT pass_id, reject_reason IS NULL AS valid, reject_reason,
          CASE WHEN reject_reason IS NULL THEN json_extract_string(json_text, '$.gate') END AS gate,
          CASE WHEN reject_reason IS NULL THEN json_extract_string(json_text, '$.flight_number') END AS flight_number,
          CASE WHEN reject_reason IS NULL THEN coalesce(TRY_CAST(json_extract_string(json_text, '$.destination.confidence')
                                                        AS DOUBLE), 0.0) END AS dest_confidence,
          CASE WHEN reject_reason IS NULL THEN coalesce(TRY_CAST(json_extract_string(json_text, '$.terminal.confidence')
                                                        AS DOUBLE), 0.0) END AS terminal_confidence
        FROM r""",
    "extract_route": TEXT_CTES + "SELECT pass_id, dep_city, dest_city, route_source, route_confidence FROM pt",
    "extract_iata": TEXT_CTES + "SELECT pass_id, dep_iata, dest_iata FROM pt",
    "extract_times": TEXT_CTES + "SELECT pass_id, boarding_time, departure_time FROM pt",
    "extract_flight_gate": TEXT_CTES + "SELECT pass_id, flight_number, gate FROM pt",
    "extract_terminal": TEXT_CTES + "SELECT pass_id, terminal_value, terminal_source, terminal_confidence FROM pt",
    "confidence_assumptions": TEXT_CTES + """
        SELECT field, coalesce(source, 'none') AS source, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_violations
        FROM (SELECT 'terminal' AS field, terminal_source AS source FROM pt
              UNION ALL SELECT 'route', route_source FROM pt) GROUP BY field, coalesce(source, 'none')""",
    "apply_manual_edits": f"""
        WITH passes AS ({PASSES_EXT}),
        e AS (SELECT pass_id, {", ".join(f"{v} AS e_{k}" for k, v in EDITS_SQL.items())}
              FROM passes WHERE pass_id % 6 = 0)
        SELECT p.pass_id, e.pass_id IS NOT NULL AS edited,
          CASE WHEN e.pass_id IS NOT NULL THEN nullif(trim(e.e_airport_iata), '') ELSE p.airport_code END AS airport_iata,
          CASE WHEN e.pass_id IS NOT NULL THEN nullif(trim(e.e_dest_iata), '') ELSE p.dest_iata END AS dest_iata,
          CASE WHEN e.pass_id IS NOT NULL THEN nullif(trim(e.e_airport_city), '') END AS airport_city,
          CASE WHEN e.pass_id IS NOT NULL THEN nullif(trim(e.e_dest_city), '') END AS dest_city, 0 AS n_assumptions,
          CAST(CASE WHEN e.pass_id IS NOT NULL
                    THEN (CASE WHEN trim(e.e_dest_iata) <> '' OR trim(e.e_dest_city) <> '' THEN 0.99 ELSE 0.0 END)
                    WHEN p.dest_iata IS NOT NULL THEN 1.0 ELSE 0.0 END AS DOUBLE) AS dest_confidence,
          CASE WHEN e.pass_id IS NOT NULL THEN nullif(trim(e.e_terminal), '') ELSE p.terminal END AS terminal_value,
          CASE WHEN e.pass_id IS NOT NULL THEN (CASE WHEN nullif(trim(e.e_terminal), '') IS NOT NULL THEN 'printed' END)
               ELSE p.terminal_source END AS terminal_source,
          CAST(CASE WHEN e.pass_id IS NOT NULL
                    THEN (CASE WHEN nullif(trim(e.e_terminal), '') IS NOT NULL THEN 0.99 ELSE 0.0 END)
               ELSE p.terminal_confidence END AS DOUBLE) AS terminal_confidence,
          CASE WHEN e.pass_id IS NOT NULL THEN nullif(trim(e.e_gate), '') ELSE p.gate END AS gate,
          CASE WHEN e.pass_id IS NOT NULL THEN nullif(trim(e.e_flight), '') ELSE p.flight_number END AS flight_number,
          CASE WHEN e.pass_id IS NOT NULL THEN nullif(trim(e.e_departure), '') ELSE p.departure END AS departure,
          CASE WHEN e.pass_id IS NOT NULL THEN nullif(trim(e.e_boarding), '') ELSE p.boarding END AS boarding
        FROM passes p LEFT JOIN e ON e.pass_id = p.pass_id""",
}
