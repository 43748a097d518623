"""DuckDB oracle SQL for web-page extraction (§2.2).

The expected regions of the embedded objects are the columns that they were made of, titles are cased with list functions, lists use 1-based subscripts. The expected
fields of cards and amenities are the fixture's own columns that the markup was made of,
not patterns run over it; the other HTML fixtures are the shared SQL expressions.
"""

from __future__ import annotations

from concourse.oracle.serving import lounges_sql
from concourse.plans.fixtures import _PATH_SQL, DETAIL_HTML_SQL

# The markup of the driver's ``pages`` table, as it stands there.
HREF_RE = 'href="([^"]*)"'
CARD_RE = '<li><a href="([^"]*)">([^<]*)</a></li>'
TITLE_RE, H1_RE = "<title>([^<]*)</title>", "<h1>([^<]*)</h1>"
LANG_RE, COUNT_RE = '<html lang="([^"]*)"', '<span class="count">([^<]*)</span>'
WS = r"'^\s+|\s+$', '', 'g'"


def trimws(x: str) -> str:
    return f"regexp_replace({x}, {WS})"


def decoded(x: str) -> str:
    """The named characters that the driver's pages use, the ampersand last."""
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{c}')"
    return x


EMBEDDED = f"""
WITH flat AS (
  SELECT event_id AS page_id, 'R0' AS region, {_PATH_SQL} AS url, 'n }} "q" é / ' || CAST(event_id AS VARCHAR) AS name
  FROM events WHERE event_id % 13 <> 0),
vals AS (
  SELECT page_id, region, '{{"items":[{{"url":"' || url || '","name":"n }} \\"q\\" é / ' || CAST(page_id AS VARCHAR) || '"}}]}}' AS value FROM flat
  UNION ALL SELECT page_id, 'R1', '5' FROM flat),
country AS (
  SELECT page_id,
    CASE WHEN len(string_split(url, '/')) >= 3
         THEN array_to_string(list_transform(
                regexp_extract_all(replace(string_split(url, '/')[3], '-', ' '), '[^\\p{{L}}]+|\\p{{L}}+'),
                lambda t: upper(t[1]) || lower(t[2:])), '')
         ELSE 'Unknown' END AS country,
    name AS airport_name, 'https://x.example' || url AS url, url AS relative_path
  FROM flat)
"""

CARDS = f"""
WITH lounges AS ({lounges_sql()}),
parsed AS (
  SELECT airport_code, k, CASE WHEN k % 29 <> 0 THEN detail_url END AS detail_url,
    CASE WHEN k % 29 <> 0 THEN lounge_id END AS lounge_id,
    CASE WHEN k % 23 <> 0 THEN trim(name) || CASE WHEN k % 4 = 1 THEN ' & Bar' ELSE '' END END AS name,
    coalesce(terminal, 'N/A') AS terminal, opening_hours, image_url,
    CASE WHEN k % 29 = 0 THEN 'missing href' WHEN k % 23 = 0 THEN 'missing name' END AS reject_reason
  FROM lounges),
good AS (SELECT * FROM parsed WHERE reject_reason IS NULL),
d AS (SELECT k, detail_url AS url, {DETAIL_HTML_SQL} AS html FROM lounges WHERE k % 10 <> 0),
dp AS (
  SELECT k, url, html,
    list_filter(list_transform(regexp_extract_all(regexp_extract(html,
        '(?s)<button[^>]*>\\s*<h2>Location</h2>\\s*</button>\\s*<div>(.*?)</div>', 1), '(?s)<li>(.*?)</li>', 1),
        lambda x: {trimws("x")}), lambda x: x <> '') AS loc_p,
    list_transform(regexp_extract_all(regexp_extract(html, '(?s)<h2>Location</h2>.*?<ul>(.*?)</ul>', 1),
        '(?s)<li>(.*?)</li>', 1), lambda x: {trimws("x")}) AS loc_f,
    list_filter(list_transform(regexp_extract_all(regexp_extract(html,
        '(?s)<button[^>]*>\\s*<h2>Conditions</h2>\\s*</button>\\s*<div>(.*?)</div>', 1), '(?s)<li>(.*?)</li>', 1),
        lambda x: {trimws("x")}), lambda x: x <> '') AS cond_p,
    list_transform(regexp_extract_all(regexp_extract(html, '(?s)<h2>Conditions</h2>.*?<ul>(.*?)</ul>', 1),
        '(?s)<li>(.*?)</li>', 1), lambda x: {trimws("x")}) AS cond_f
  FROM d),
dp2 AS (
  SELECT k, url,
    CASE WHEN len(loc_p) > 0 THEN loc_p ELSE loc_f END AS loc,
    CASE WHEN len(cond_p) > 0 THEN cond_p ELSE cond_f END AS cond
  FROM dp),
details AS (
  SELECT url, CASE k % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'Wi-Fi' WHEN 2 THEN 'Showers (Free, 24h); Bar & Grill'
         WHEN 3 THEN 'Quiet room (Adults)' ELSE 'Spa (Paid); Food (Hot, Cold); News' END AS amenities,
    CASE WHEN len(loc) > 0 THEN 'Location:' || chr(10) || '- ' || array_to_string(loc, chr(10) || '- ')
         ELSE 'N/A' END AS access_notes,
    loc, cond
  FROM dp2),
joined AS (
  SELECT g.*, CASE WHEN x.url IS NOT NULL THEN x.amenities ELSE 'N/A' END AS amenities,
         coalesce(x.access_notes, 'N/A') AS access_notes,
         CASE WHEN x.url IS NOT NULL THEN x.cond ELSE CAST([] AS VARCHAR[]) END AS conditions
  FROM good g LEFT JOIN details x ON x.url = g.detail_url)
"""

ORACLE = {
    "filter_detail_links": f"""
        WITH l AS (SELECT page_id, regexp_extract_all(html, '{HREF_RE}', 1) AS hrefs FROM pages)
        SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, hrefs[i] AS href
        FROM l, range(1, len(hrefs) + 1) r(i) WHERE contains(hrefs[i], '/the')""",
    "embedded_json_extract": EMBEDDED + "SELECT page_id, region, value FROM vals",
    "embedded_json_repair": EMBEDDED + """
        SELECT page_id, true AS valid, 2 AS n_regions FROM flat""",
    "region_airports_flatten": EMBEDDED + "SELECT page_id, region, url, name FROM flat",
    "airport_country": EMBEDDED + "SELECT * FROM country",
    "filter_countries": EMBEDDED + """
        SELECT * FROM country WHERE lower(country) IN ('united kingdom', 'united states of america')""",
    "page_header_fields": f"""
        SELECT page_id,
          coalesce(CASE WHEN regexp_matches(html, '{H1_RE}') THEN {trimws(decoded(f"regexp_extract(html, '{H1_RE}', 1)"))} END,
                   url) AS airport_name,
          coalesce(CASE WHEN regexp_matches(html, '{LANG_RE}') THEN {trimws(f"regexp_extract(html, '{LANG_RE}', 1)")} END,
                   'N/A') AS airport_code,
          coalesce(CASE WHEN regexp_matches(html, '{TITLE_RE}') THEN {trimws(decoded(f"regexp_extract(html, '{TITLE_RE}', 1)"))} END,
                   'N/A') AS airport_location,
          coalesce(CASE WHEN regexp_matches(html, '{COUNT_RE}') THEN {trimws(decoded(f"regexp_extract(html, '{COUNT_RE}', 1)"))} END,
                   'N/A') AS total_experiences
        FROM pages""",
    "card_explode": f"""
        WITH c AS (SELECT page_id, regexp_extract_all(html, '{CARD_RE}', 1) AS hrefs,
                          regexp_extract_all(html, '{CARD_RE}', 2) AS names FROM pages)
        SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, hrefs[i] AS href, names[i] AS name
        FROM c, range(1, len(hrefs) + 1) r(i)
        UNION ALL
        SELECT page_id, NULL, NULL, NULL FROM c WHERE len(hrefs) = 0""",
    "detail_key": """
        SELECT page_id, url, string_split(string_split(url, '/')[-1], '?')[1] AS detail_key FROM pages""",
    "field_defaults": CARDS + "SELECT lounge_id, terminal, opening_hours, image_url FROM good",
    "amenity_format": CARDS + "SELECT url, amenities FROM details",
    "section_items": CARDS + """
        SELECT url, array_to_string(loc, '|') AS location_items, CAST(len(loc) AS INTEGER) AS n_location,
               array_to_string(cond, '|') AS conditions, CAST(len(cond) AS INTEGER) AS n_conditions
        FROM details""",
    "access_notes": CARDS + "SELECT url, access_notes FROM details",
    "detail_join": CARDS + """
        SELECT lounge_id, name, amenities, access_notes, array_to_string(conditions, '|') AS conditions_text
        FROM joined""",
    "nest_lounges": CARDS + """
        , airports AS (
          SELECT 'A' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS airport_code FROM nation
          UNION ALL
          SELECT 'R' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0') FROM region)
        SELECT a.airport_code, count(j.lounge_id) AS n_lounges, min(j.lounge_id) AS first_lounge_id,
               max(j.lounge_id) AS last_lounge_id
        FROM airports a LEFT JOIN joined j ON j.airport_code = a.airport_code
        GROUP BY a.airport_code""",
    "quarantine_bad_records": CARDS + """
        SELECT k, lounge_id, CASE WHEN reject_reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reject_reason
        FROM parsed""",
}
