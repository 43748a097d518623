"""DuckDB oracle SQL for §2.3 and §2.6, written independently of the Spark plan.

Hours are a literal table of merged intervals (days and minutes from midnight), replicated
over neighbouring days; the window is computed in minutes of day; ranking uses
plain window functions. Only the fixture definitions are shared with Spark.
"""

from __future__ import annotations

A_NO_TIMES = "Boarding and departure times are missing; no time filtering was applied."
A_DEPARTURE_USED = "Boarding time not provided; departure time used as the end of the stay."
A_OVERNIGHT = "End time is earlier than the current time; assumed to be on the next day (overnight)."
A_NO_DESTINATION = "Destination is missing; no destination context."
ALTERNATIVES = "Consider rest areas, cafes or quiet seating near your gate."


def lounges_sql(source: str = "customer") -> str:
    if source == "customer":
        k, name, nk, table, prefix = "c_custkey", "c_name", "c_nationkey", "customer", "L"
        amen = "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END"
    else:
        k, name, nk, table, prefix = "s_suppkey", "s_name", "s_nationkey", "supplier", "S"
        amen = "CASE WHEN s_suppkey % 5 <> 0 THEN 'SUPPLIER' END"
    lid = f"'{prefix}' || lpad(CAST({k} AS VARCHAR), 9, '0')"
    return f"""
    SELECT {lid} AS lounge_id, {name} AS name,
      'A' || lpad(CAST({nk} AS VARCHAR), 2, '0') AS airport_code,
      CASE {k} % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '2' WHEN 3 THEN '3'
                   WHEN 4 THEN 'B' WHEN 5 THEN 'N/A' END AS terminal,
      CASE WHEN {nk} % 5 = 1 OR {k} % 6 = 0
             THEN (CASE WHEN {nk} % 3 = 0 THEN 'Open 24 hours' ELSE '09:00 - 17:00' END)
           WHEN {k} % 6 = 1 THEN
             (CASE {k} // 6 % 6 WHEN 0 THEN '05:00 - 22:00' WHEN 1 THEN '05:00 - 22:00 daily' WHEN 2 THEN '0500 - 2200'
                   WHEN 3 THEN 'Mon-Fri 06:00-12:00, 13:00-20:00' WHEN 4 THEN '05:00-22:00 (Mon, Wed, Fri)'
                   ELSE '24 hours daily except Sat' END)
           WHEN {k} % 6 = 2 THEN '18:00 - 02:00'
           WHEN {k} % 6 = 3 THEN '06:00 - 12:00, 12:00 - 23:30'
           WHEN {k} % 6 = 4 THEN 'N/A'
           ELSE '00:00 - 11:00, 13:00 - 00:00' END AS opening_hours,
      {amen} AS amenities,
      CASE WHEN {k} % 4 = 0 THEN 'N/A'
           ELSE 'Location:' || chr(10) || '- Airside, level ' || CAST({k} % 3 AS VARCHAR) END AS access_notes,
      CASE WHEN {k} % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['Maximum stay 3 hours'] END AS conditions,
      CASE WHEN {k} % 3 = 0 THEN '' ELSE 'https://x.example/img/' || {lid} || '.jpg' END AS image_url,
      'https://x.example/lounges/' || {lid} || '?ref=list' AS detail_url,
      {k} AS k
    FROM {table}"""


PASSES_SQL = """
    SELECT event_id AS pass_id, ts AS now_ts, user_id, event_type,
      'A' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') AS airport_code,
      CASE WHEN event_type NOT IN ('error', 'view')
           THEN strftime(ts + to_minutes(30 + 3 * CAST(json_extract_string(props, '$.k') AS INTEGER)), '%H:%M') END AS boarding,
      CASE WHEN event_type <> 'error'
           THEN strftime(ts + to_minutes(60 + 3 * CAST(json_extract_string(props, '$.k') AS INTEGER)), '%H:%M') END AS departure,
      CASE event_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '2C' WHEN 4 THEN '2' END AS terminal,
      CAST(CASE WHEN event_id % 5 IN (0, 1, 4) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS terminal_confidence,
      CASE WHEN event_id % 5 = 2 THEN 'B12' END AS gate,
      CASE WHEN event_id % 11 <> 0 THEN 'A' || lpad(CAST((user_id + 7) % 25 AS VARCHAR), 2, '0') END AS dest_iata
    FROM events"""

# Merged open intervals of the fixture schedules: first and last day on which they begin (Monday = 0) and
# minutes from that day's midnight. 'Open 24 hours' is always open, 'N/A' is unknown.
HRS_SQL = """
    SELECT * FROM (VALUES
      ('09:00 - 17:00', 0, 6, 540, 1020),
      ('05:00 - 22:00', 0, 6, 300, 1320),
      ('05:00 - 22:00 daily', 0, 6, 300, 1320),
      ('0500 - 2200', 0, 6, 300, 1320),
      ('Mon-Fri 06:00-12:00, 13:00-20:00', 0, 4, 360, 720),
      ('Mon-Fri 06:00-12:00, 13:00-20:00', 0, 4, 780, 1200),
      ('05:00-22:00 (Mon, Wed, Fri)', 0, 0, 300, 1320),
      ('05:00-22:00 (Mon, Wed, Fri)', 2, 2, 300, 1320),
      ('05:00-22:00 (Mon, Wed, Fri)', 4, 4, 300, 1320),
      ('24 hours daily except Sat', 6, 6, 0, 8640),
      ('18:00 - 02:00', 0, 6, 1080, 1560),
      ('06:00 - 12:00, 12:00 - 23:30', 0, 6, 360, 1410),
      ('00:00 - 11:00, 13:00 - 00:00', 0, 6, 780, 2100)) t(opening_hours, first_day, last_day, o, c)"""

# Raw (unmerged) daily segments as printed, with the days on which they begin.
RAW_SEG_SQL = """
    SELECT * FROM (VALUES
      ('Open 24 hours', 0, 6, 0, 1440),
      ('09:00 - 17:00', 0, 6, 540, 1020),
      ('05:00 - 22:00', 0, 6, 300, 1320),
      ('05:00 - 22:00 daily', 0, 6, 300, 1320),
      ('0500 - 2200', 0, 6, 300, 1320),
      ('Mon-Fri 06:00-12:00, 13:00-20:00', 0, 4, 360, 720),
      ('Mon-Fri 06:00-12:00, 13:00-20:00', 0, 4, 780, 1200),
      ('05:00-22:00 (Mon, Wed, Fri)', 0, 0, 300, 1320),
      ('05:00-22:00 (Mon, Wed, Fri)', 2, 2, 300, 1320),
      ('05:00-22:00 (Mon, Wed, Fri)', 4, 4, 300, 1320),
      ('24 hours daily except Sat', 0, 4, 0, 1440),
      ('24 hours daily except Sat', 6, 6, 0, 1440),
      ('18:00 - 02:00', 0, 6, 1080, 1560),
      ('06:00 - 12:00, 12:00 - 23:30', 0, 6, 360, 720),
      ('06:00 - 12:00, 12:00 - 23:30', 0, 6, 720, 1410),
      ('00:00 - 11:00, 13:00 - 00:00', 0, 6, 0, 660),
      ('00:00 - 11:00, 13:00 - 00:00', 0, 6, 780, 1440)) t(opening_hours, first_day, last_day, o, c)"""


def base_ctes(source: str = "customer") -> str:
    return f"""
WITH lounges AS ({lounges_sql(source)}),
passes AS ({PASSES_SQL}),
hrs AS ({HRS_SQL}),
rep AS (SELECT opening_hours, dow, o + 1440 * d AS o, c + 1440 * d AS c
        FROM hrs, range(-7, 3) r(d), range(0, 7) t(dow)
        WHERE (dow + d + 7) % 7 BETWEEN first_day AND last_day),
capped AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY airport_code ORDER BY lounge_id) AS INTEGER) AS catalog_pos
  FROM lounges QUALIFY catalog_pos <= 50),
terms AS (
  SELECT airport_code,
         list_sort(list_distinct(list(terminal) FILTER (WHERE terminal <> ''))) AS avail,
         count(*) AS n_lounges,
         count(*) FILTER (WHERE opening_hours = 'N/A') AS n_unknown
  FROM lounges GROUP BY airport_code),
win AS (
  SELECT p.*, isodow(now_ts) - 1 AS dow, hour(now_ts) * 60 + minute(now_ts) AS s, strftime(now_ts, '%H:%M') AS start_hhmm,
         coalesce(boarding, departure) AS end_hhmm,
         CAST(substr(coalesce(boarding, departure), 1, 2) AS INTEGER) * 60
           + CAST(substr(coalesce(boarding, departure), 4, 2) AS INTEGER) AS e_mod
  FROM passes p),
win2 AS (
  SELECT *, CASE WHEN end_hhmm IS NULL THEN 'none' ELSE 'open' END AS window_status,
         CASE WHEN e_mod < s THEN e_mod + 1440 ELSE e_mod END AS e
  FROM win),
ctx0 AS (
  SELECT w.*, coalesce(t.avail, CAST([] AS VARCHAR[])) AS avail, coalesce(t.n_lounges, 0) AS n_lounges,
         coalesce(t.n_unknown, 0) AS n_unknown,
         regexp_extract(w.terminal, '^([0-9]+)', 1) AS mapped,
         regexp_extract(upper(w.gate), '^([A-Z]+)', 1) AS letters
  FROM win2 w LEFT JOIN terms t ON t.airport_code = w.airport_code),
ctx AS (
  SELECT *,
    CASE WHEN terminal IS NOT NULL AND list_contains(avail, terminal) THEN 1
         WHEN terminal IS NOT NULL AND mapped <> '' AND list_contains(avail, mapped) THEN 2
         WHEN terminal IS NULL AND letters <> '' AND list_contains(avail, letters) THEN 3
         ELSE 4 END AS tier
  FROM ctx0),
ctx2 AS (
  SELECT *, CASE tier WHEN 1 THEN terminal WHEN 2 THEN mapped WHEN 3 THEN letters END AS eff,
    CASE WHEN tier = 2 THEN 'Terminal ' || terminal || ' mapped to terminal ' || mapped || '.'
         WHEN tier = 3 THEN 'Terminal inferred as ' || letters || ' from gate ' || gate || '.'
         WHEN tier = 4 AND terminal IS NOT NULL
           THEN 'Terminal ' || terminal || ' matches no lounge terminal; recommendations spread across terminals.'
         WHEN tier = 4 THEN 'Terminal unknown; recommendations spread across terminals.' END AS t_assumption
  FROM ctx),
cand AS (
  SELECT c.pass_id, c.airport_code, c.window_status, c.dow, c.s, c.e, c.tier, c.eff, c.start_hhmm, c.end_hhmm,
         l.lounge_id, l.terminal AS l_terminal, l.opening_hours, l.name, l.amenities, l.access_notes, l.detail_url
  FROM ctx2 c JOIN lounges l ON l.airport_code = c.airport_code),
covered AS (
  SELECT * FROM cand WHERE window_status = 'none' OR opening_hours = 'Open 24 hours'
  UNION ALL
  SELECT cand.* FROM cand JOIN rep ON rep.opening_hours = cand.opening_hours AND rep.dow = cand.dow
     AND rep.o <= cand.s AND rep.c >= cand.e
  WHERE cand.window_status = 'open'),
sp AS (
  SELECT *, coalesce(tier < 4 AND l_terminal = eff, false) AS matched,
         row_number() OVER (PARTITION BY pass_id, l_terminal ORDER BY lounge_id) AS spread
  FROM covered),
rk AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY pass_id ORDER BY matched DESC, spread, lounge_id) AS INTEGER) AS rank
  FROM sp),
top5 AS (
  SELECT *,
    CASE WHEN matched AND tier = 1 THEN 'Same terminal as your flight (' || l_terminal || ').'
         WHEN matched AND tier = 2 THEN 'In terminal ' || l_terminal || ', mapped from your terminal.'
         WHEN matched AND tier = 3 THEN 'In terminal ' || l_terminal || ', inferred from your gate.'
         WHEN l_terminal IS NOT NULL THEN 'In terminal ' || l_terminal || '.'
         ELSE 'Terminal not listed.' END
    || CASE WHEN window_status = 'open' THEN ' Open for your whole stay (' || start_hhmm || ' to ' || end_hhmm || ').'
            ELSE '' END AS why_recommended
  FROM rk WHERE rank <= 5),
routes AS (
  SELECT DISTINCT 'A' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0') AS origin,
         'A' || lpad(CAST((o_custkey + 7) % 25 AS VARCHAR), 2, '0') AS dest,
         CAST(30 + 17 * abs(o_custkey % 25 - (o_custkey + 7) % 25) AS INTEGER) AS minutes
  FROM orders WHERE (o_custkey % 25 + (o_custkey + 7) % 25) % 4 <> 0),
dest AS (
  SELECT p.pass_id, p.dest_iata IS NOT NULL AS has_destination, p.dest_iata,
    CAST(NULL AS VARCHAR) AS dest_city,
    CASE WHEN p.dest_iata IS NOT NULL AND r.minutes IS NOT NULL THEN
      (CASE WHEN r.minutes < 180 THEN 'short-haul' WHEN r.minutes < 360 THEN 'medium-haul' ELSE 'long-haul' END)
      || ' (~' || CAST(r.minutes AS VARCHAR) || ' min)' END AS flight_duration_estimate,
    CASE WHEN p.dest_iata IS NOT NULL AND r.minutes IS NOT NULL AND p.departure IS NOT NULL THEN
      'Arrives around ' || printf('%02d:%02d',
          ((CAST(substr(p.departure, 1, 2) AS INTEGER) * 60 + CAST(substr(p.departure, 4, 2) AS INTEGER) + r.minutes) % 1440) // 60,
          ((CAST(substr(p.departure, 1, 2) AS INTEGER) * 60 + CAST(substr(p.departure, 4, 2) AS INTEGER) + r.minutes) % 1440) % 60)
      || ' departure-airport time'
      || CASE WHEN CAST(substr(p.departure, 1, 2) AS INTEGER) * 60 + CAST(substr(p.departure, 4, 2) AS INTEGER) + r.minutes >= 1440
              THEN ' (next day)' ELSE '' END || '.' END AS arrival_insight,
    CASE WHEN p.dest_iata IS NULL THEN NULL
         WHEN r.minutes IS NULL THEN 'No route data; flight duration and arrival not estimated.'
         ELSE 'Duration from the route table; time zones unknown.' END AS uncertainty
  FROM passes p LEFT JOIN routes r ON r.origin = p.airport_code AND r.dest = p.dest_iata),
kept AS (SELECT pass_id, count(*) AS kept FROM covered GROUP BY pass_id),
excl AS (
  SELECT c.pass_id, CAST(c.n_lounges AS BIGINT) AS candidates, CAST(coalesce(k.kept, 0) AS BIGINT) AS kept,
         CAST(CASE WHEN c.window_status = 'open' THEN c.n_unknown ELSE 0 END AS BIGINT) AS excluded_unknown
  FROM ctx2 c LEFT JOIN kept k ON k.pass_id = c.pass_id),
wassume AS (
  SELECT pass_id, [x FOR x IN [
      CASE WHEN window_status = 'none' THEN '{A_NO_TIMES}' END,
      CASE WHEN boarding IS NULL AND departure IS NOT NULL THEN '{A_DEPARTURE_USED}' END,
      CASE WHEN window_status = 'open' AND e >= 1440 THEN '{A_OVERNIGHT}' END] IF x IS NOT NULL] AS wa
  FROM win2)
"""


def _q(select: str, source: str = "customer") -> str:
    return base_ctes(source) + select


#: Spellings of one schedule.
SAME_HOURS = "CASE WHEN opening_hours IN ('05:00 - 22:00 daily', '0500 - 2200') THEN '05:00 - 22:00' ELSE opening_hours END"
FLAT = ("airport_code, lounge_id, name, terminal, opening_hours, amenities, access_notes, "
        "array_to_string(conditions, '|') AS conditions_text, image_url, detail_url")

ROLL_CTE = f"""
        , roll AS (
          SELECT c.pass_id,
            list_concat(list_concat([x FOR x IN [c.t_assumption] IF x IS NOT NULL], a.wa),
                        [CASE WHEN d.has_destination THEN d.uncertainty ELSE '{A_NO_DESTINATION}' END]) AS al
          FROM ctx2 c JOIN wassume a ON a.pass_id = c.pass_id JOIN dest d ON d.pass_id = c.pass_id)"""

ADVISORY_SELECT = f"""
        SELECT c.pass_id,
          CASE WHEN c.window_status = 'open'
               THEN 'Your stay runs from ' || c.start_hhmm || ' to ' || c.end_hhmm
                    || CASE WHEN c.e >= 1440 THEN ' (overnight)' ELSE '' END || '.'
               ELSE 'No boarding or departure time is known, so every lounge is considered.' END
          || CASE WHEN len(c.avail) > 0 THEN ' Lounges are available in terminals ' || array_to_string(c.avail, ', ') || '.' ELSE '' END
          || CASE WHEN x.candidates > 0 THEN ' ' || CAST(x.kept AS VARCHAR) || ' of ' || CAST(x.candidates AS VARCHAR)
                  || ' lounges cover your whole stay; ' || CAST(x.candidates - x.kept - x.excluded_unknown AS VARCHAR)
                  || ' excluded due to opening hours, ' || CAST(x.excluded_unknown AS VARCHAR) || ' with unknown hours.'
                  ELSE '' END
          || CASE WHEN x.candidates = 0 THEN ' No lounges are listed at this airport. {ALTERNATIVES}'
                  WHEN x.kept = 0 THEN ' No lounge is open for your whole stay. {ALTERNATIVES}' ELSE '' END
          || CASE WHEN d.has_destination THEN ' Destination: ' || d.dest_iata
                  || CASE WHEN d.flight_duration_estimate IS NOT NULL THEN ', ' || d.flight_duration_estimate ELSE '' END
                  || '.' ELSE '' END AS advisory
        FROM ctx2 c JOIN excl x ON x.pass_id = c.pass_id JOIN dest d ON d.pass_id = c.pass_id"""

ORACLE = {
    "unnest_lounges": _q(f"SELECT {FLAT} FROM lounges"),
    "lounges_for_airport": _q(f"SELECT {FLAT} FROM lounges WHERE airport_code = 'A07'"),
    "catalog_contract": _q("""
        SELECT airport_code, lounge_id, coalesce(amenities, '') AS amenities,
               CAST(len(conditions) AS INTEGER) AS n_conditions,
               CASE WHEN k % 97 = 0 THEN 'missing name' END AS reject_reason
        FROM lounges"""),
    "require_airport": _q("""
        SELECT pass_id,
               CASE WHEN pass_id % 13 = 0 THEN NULL WHEN pass_id % 13 = 1 THEN '' ELSE airport_code END AS airport_code,
               CASE WHEN pass_id % 13 IN (0, 1) THEN 'Airport IATA required' END AS reject_reason
        FROM passes"""),
    "cap_per_airport": _q("SELECT airport_code, lounge_id, catalog_pos FROM capped"),
    "available_terminals": _q("""
        SELECT airport_code, array_to_string(avail, ',') AS terminals, CAST(len(avail) AS INTEGER) AS n_terminals
        FROM terms"""),
    "pass_lounge_join": _q("""
        , per AS (SELECT airport_code, terminal, count(*) AS n_lounges FROM lounges GROUP BY airport_code, terminal)
        SELECT c.pass_id, c.airport_code, l.terminal, l.n_lounges
        FROM ctx2 c JOIN per l ON l.airport_code = c.airport_code"""),
    "stay_window": _q("""
        SELECT w.pass_id, w.window_status, w.start_hhmm, w.end_hhmm,
               CASE WHEN w.end_hhmm IS NOT NULL THEN w.e >= 1440 END AS overnight,
               CAST(w.e - w.s AS BIGINT) AS duration_min,
               array_to_string(a.wa, ' | ') AS window_assumptions
        FROM win2 w JOIN wassume a ON a.pass_id = w.pass_id"""),
    "hours_to_intervals": base_ctes() + f""",
        raw AS ({RAW_SEG_SQL}),
        present AS (SELECT DISTINCT opening_hours FROM lounges)
        SELECT p.opening_hours, CAST(d AS INTEGER) AS day, CAST(r.o AS INTEGER) AS open_min,
               CAST(r.c AS INTEGER) AS close_min
        FROM present p JOIN raw r ON r.opening_hours = p.opening_hours, range(0, 7) t(d)
        WHERE d BETWEEN r.first_day AND r.last_day
        UNION ALL
        SELECT opening_hours, NULL, NULL, NULL FROM present WHERE opening_hours = 'N/A'""",
    "merge_intervals": base_ctes() + f""",
        raw AS ({RAW_SEG_SQL}),
        present AS (SELECT DISTINCT opening_hours FROM lounges),
        reps AS (SELECT r.opening_hours, r.o + 1440 * d AS o, r.c + 1440 * d AS c
                 FROM raw r JOIN present p ON p.opening_hours = r.opening_hours, range(-7, 14) t(d)
                 WHERE (d + 7) % 7 BETWEEN r.first_day AND r.last_day),
        ord AS (SELECT *, max(c) OVER (PARTITION BY opening_hours ORDER BY o, c
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_c FROM reps),
        isl AS (SELECT *, sum(CASE WHEN prev_c IS NULL OR o > prev_c THEN 1 ELSE 0 END)
                          OVER (PARTITION BY opening_hours ORDER BY o, c ROWS UNBOUNDED PRECEDING) AS grp FROM ord)
        SELECT opening_hours, CAST(min(o) AS INTEGER) AS o, CAST(max(c) AS INTEGER) AS c
        FROM isl GROUP BY opening_hours, grp""",
    "hours_cover_window": _q("""
        SELECT pass_id, airport_code, l_terminal AS terminal, count(*) AS n_lounges
        FROM covered GROUP BY pass_id, airport_code, l_terminal"""),
    "covering_groups": _q("""
        , named AS (
          SELECT airport_code || '/' || coalesce(terminal, '-') || '/' || min(lounge_id) AS group_id, min(lounge_id) AS least
          FROM lounges GROUP BY airport_code, terminal, SAME_HOURS)
        SELECT c.pass_id, n.group_id FROM covered c JOIN named n ON n.least = c.lounge_id""").replace("SAME_HOURS", SAME_HOURS),
    "group_members": _q("""
        SELECT airport_code || '/' || coalesce(terminal, '-') || '/'
               || min(lounge_id) OVER (PARTITION BY airport_code, terminal, SAME_HOURS) AS group_id, lounge_id
        FROM lounges""").replace("SAME_HOURS", SAME_HOURS),
    "exclusion_summary": _q("""
        SELECT pass_id, candidates, kept, candidates - kept - excluded_unknown AS excluded_time,
               excluded_unknown, candidates > 0 AND kept = 0 AS none_cover
        FROM excl"""),
    "terminal_match": _q("""
        SELECT pass_id, eff AS effective_terminal, CAST(tier AS INTEGER) AS terminal_tier,
               coalesce(t_assumption, '') AS terminal_assumption FROM ctx2"""),
    "terminal_spread": _q("""
        SELECT pass_id, lounge_id, CAST(spread AS INTEGER) AS spread FROM sp WHERE spread <= 5""", "supplier"),
    "top_lounges": _q("SELECT pass_id, lounge_id, rank FROM top5"),
    "recommendation_rows": _q("""
        SELECT pass_id, rank, lounge_id, name, l_terminal AS terminal, opening_hours,
               coalesce(amenities, '') AS amenities, access_notes, detail_url AS source_url, why_recommended
        FROM top5""", "supplier"),
    "destination_context": _q("SELECT * FROM dest"),
    "assumptions_rollup": _q(ROLL_CTE + """
        SELECT pass_id, CAST(len(al) AS INTEGER) AS n_assumptions, array_to_string(al, ' | ') AS assumptions
        FROM roll""", "supplier"),
    "advisory_text": _q(ADVISORY_SELECT, "supplier"),
    "advisory_record": _q(ROLL_CTE + f""",
        adv AS ({ADVISORY_SELECT}),
        recs AS (
          SELECT pass_id, string_agg(concat_ws('|', lounge_id, name, coalesce(l_terminal, '-'), opening_hours,
                   coalesce(amenities, ''), coalesce(access_notes, '-'), detail_url, why_recommended),
                   ' & ' ORDER BY rank) AS recommendations
          FROM top5 GROUP BY pass_id)
        SELECT c.pass_id, CASE WHEN c.window_status = 'open' THEN c.start_hhmm END AS window_start,
               CASE WHEN c.window_status = 'open' THEN c.end_hhmm END AS window_end,
               CASE WHEN c.window_status = 'open' THEN c.e >= 1440 END AS overnight,
               array_to_string(c.avail, ',') AS terminals, a.advisory, coalesce(r.recommendations, '') AS recommendations,
               array_to_string(o.al, ' | ') AS assumptions, d.dest_iata, d.flight_duration_estimate AS duration,
               d.arrival_insight AS arrival, d.uncertainty
        FROM ctx2 c JOIN adv a ON a.pass_id = c.pass_id JOIN roll o ON o.pass_id = c.pass_id
             JOIN dest d ON d.pass_id = c.pass_id LEFT JOIN recs r ON r.pass_id = c.pass_id""", "supplier"),
    "recommendation_integrity": _q("""
        , model AS (
          SELECT pass_id, 'S9' || lpad(CAST(pass_id AS VARCHAR), 8, '0') AS lounge_id FROM passes WHERE pass_id % 17 = 0
          UNION ALL
          SELECT pass_id, 'S000000000' FROM passes WHERE pass_id % 17 = 1)
        SELECT m.pass_id, m.lounge_id FROM model m JOIN passes p ON p.pass_id = m.pass_id
        WHERE NOT EXISTS (SELECT 1 FROM lounges c WHERE c.airport_code = p.airport_code AND c.lounge_id = m.lounge_id)""",
                                   "supplier"),
    "report_view": _q("""
        , nrec AS (SELECT pass_id, CAST(count(*) AS INTEGER) AS n FROM top5 GROUP BY pass_id)
        SELECT c.pass_id, c.airport_code AS airport_text, 'N/A' AS airport_city_text, c.dest_iata AS destination_text,
               'N/A' AS destination_city_text, c.terminal AS terminal_text, c.gate AS gate_text,
               'XY' || CAST(c.pass_id AS VARCHAR) AS flight_text, c.departure AS departure_text,
               c.boarding AS boarding_text,
               CASE WHEN c.window_status = 'open'
                    THEN c.start_hhmm || ' to ' || c.end_hhmm || CASE WHEN c.e >= 1440 THEN ' (overnight)' ELSE '' END
               END AS time_text,
               CASE WHEN len(c.avail) > 0 THEN array_to_string(c.avail, ', ') END AS terminals_text,
               printf('%.0f', c.terminal_confidence * 100) || '%' AS terminal_confidence_text,
               coalesce(n.n, 0) AS n_recommendations
        FROM ctx2 c LEFT JOIN nrec n ON n.pass_id = c.pass_id""", "supplier"),
    "recommend_batch": _q("""
        SELECT pass_id, rank, lounge_id, name, l_terminal AS terminal, opening_hours,
               coalesce(amenities, '') AS amenities, access_notes, detail_url AS source_url,
               CAST(tier AS INTEGER) AS terminal_tier, matched, why_recommended
        FROM top5"""),
}
