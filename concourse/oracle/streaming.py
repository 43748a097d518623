"""DuckDB oracle SQL for the streaming keys (§2.7): a stream must publish exactly
what the batch computes."""

from __future__ import annotations

from concourse.oracle.serving import ORACLE as SERVING
from concourse.oracle.text import TEXT_CTES

ORACLE = {
    "recommend_stream": SERVING["recommend_batch"],
    "parse_stream": TEXT_CTES + """
        SELECT pass_id, dep_city, dest_city, dep_iata, boarding_time, departure_time, flight_number, gate, terminal_value,
               CASE WHEN dep_city IS NULL AND dep_iata IS NULL THEN 'no departure airport' END AS reject_reason,
               CASE WHEN dep_city IS NULL AND dep_iata IS NULL THEN 'rejected' ELSE 'accepted' END AS status
        FROM pt""",
    "parse_ocr_stream": TEXT_CTES + """
        SELECT pass_id, 0.875::DOUBLE AS ocr_confidence, dep_city, dest_city, dep_iata, boarding_time, departure_time, flight_number,
               gate, terminal_value, CASE WHEN dep_city IS NULL AND dep_iata IS NULL THEN 'no departure airport' END AS reject_reason,
               CASE WHEN dep_city IS NULL AND dep_iata IS NULL THEN 'rejected' ELSE 'accepted' END AS status
        FROM pt WHERE pass_id % 4 <> 0
        UNION ALL
        SELECT pass_id, 0.5, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'low_confidence' FROM pt WHERE pass_id % 4 = 0""",
}
