"""Derived input tables over the driver's parquet (see FIXTURES.md, part B).

Each builder reads only the columns it needs, so the parquet scan is pruned, and
derives rows with narrow expressions: the fixtures grow linearly with the input
tables and never pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concourse.session import read_table, spread


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _code(c: Column) -> Column:
    return F.concat(F.lit("A"), _pad(c, 2))


#: Ways in which opening hours are printed.
HOURS_FORMS = ["05:00 - 22:00", "05:00 - 22:00 daily", "0500 - 2200", "Mon-Fri 06:00-12:00, 13:00-20:00",
               "05:00-22:00 (Mon, Wed, Fri)", "24 hours daily except Sat"]


def lounges(spark: SparkSession, sf_dir: str, source: str = "customer") -> DataFrame:
    """F1 (``customer``) or F1b (``supplier``): the flat served catalog."""
    if source == "customer":
        base = read_table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("k"), F.col("c_name").alias("name"),
            F.col("c_nationkey").alias("nk"),
            F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("amenities"))
        prefix = "L"
    elif source == "supplier":
        base = read_table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"),
            F.col("s_nationkey").alias("nk"),
            F.when(F.col("s_suppkey") % 5 != 0, F.lit("SUPPLIER")).alias("amenities"))
        prefix = "S"
    else:
        raise ValueError(f"unknown lounge source {source!r}")
    k, nk = F.col("k"), F.col("nk")
    lounge_id = F.concat(F.lit(prefix), _pad(k, 9))
    t = k % 7
    terminal = (F.when(t == 0, "1").when(t.isin(1, 2), "2").when(t == 3, "3")
                .when(t == 4, "B").when(t == 5, "N/A"))
    h = F.when(nk % 5 == 1, F.lit(0)).otherwise(k % 6)
    hours = (F.when((h == 0) & (nk % 3 == 0), "Open 24 hours")
             .when(h == 0, "09:00 - 17:00")
             .when(h == 1, F.get(F.array(*map(F.lit, HOURS_FORMS)), (F.floor(k / 6) % len(HOURS_FORMS)).cast("int")))
             .when(h == 2, "18:00 - 02:00")
             .when(h == 3, "06:00 - 12:00, 12:00 - 23:30")
             .when(h == 4, "N/A")
             .otherwise("00:00 - 11:00, 13:00 - 00:00"))
    return base.select(
        lounge_id.alias("lounge_id"),
        F.col("name"),
        _code(nk).alias("airport_code"),
        terminal.alias("terminal"),
        hours.alias("opening_hours"),
        F.col("amenities"),
        F.when(k % 4 == 0, F.lit("N/A"))
         .otherwise(F.concat(F.lit("Location:\n- Airside, level "), (k % 3).cast("string")))
         .alias("access_notes"),
        F.when(k % 4 == 0, F.array().cast("array<string>"))
         .otherwise(F.array(F.lit("Maximum stay 3 hours"))).alias("conditions"),
        F.when(k % 3 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("https://x.example/img/"), lounge_id, F.lit(".jpg")))
         .alias("image_url"),
        F.concat(F.lit("https://x.example/lounges/"), lounge_id, F.lit("?ref=list")).alias("detail_url"),
    )


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airport header rows: one per nation (``A<nn>``) plus one per region (``R<nn>``)
    that has no lounges (even regions: empty array, odd regions: null array)."""
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nat = (nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
           .select(
               F.col("r_name").alias("country"),
               F.concat(F.col("n_name"), F.lit(" International")).alias("airport_name"),
               F.concat(F.lit("https://x.example/airport-lounges/"), F.lower("r_name"), F.lit("/"),
                        _code(F.col("n_nationkey"))).alias("url"),
               _code(F.col("n_nationkey")).alias("airport_code"),
               F.col("n_name").alias("airport_location"),
               F.lit(None).cast("boolean").alias("_null_array")))
    empty = region.select(
        F.col("r_name").alias("country"),
        F.concat(F.col("r_name"), F.lit(" Regional")).alias("airport_name"),
        F.concat(F.lit("https://x.example/airport-lounges/"), F.lower("r_name"), F.lit("/regional")).alias("url"),
        F.concat(F.lit("R"), _pad(F.col("r_regionkey"), 2)).alias("airport_code"),
        F.col("r_name").alias("airport_location"),
        (F.col("r_regionkey") % 2 == 1).alias("_null_array"))
    return nat.unionByName(empty)


PAGE_KEYS = 12_500  # lounge keys of one catalog page: about 500 lounges of each airport


def page_url(airport_code: Column, page: Column) -> Column:
    return F.concat(F.lit("https://x.example/airport-lounges/"), airport_code, F.lit("?page="), page.cast("string"))


def catalog_pages(airport_rows: DataFrame, last_key: int) -> DataFrame:
    """Headers of the catalog's pages: an airport's lounges stand on as many pages as the keys
    up to ``last_key`` fill."""
    number = F.explode(F.sequence(F.lit(0), F.lit(last_key // PAGE_KEYS)))
    return airport_rows.withColumn("_page", number).withColumn(
        "url", page_url(F.col("airport_code"), F.col("_page"))).drop("_page")


def on_pages(lounge_rows: DataFrame, key: Column) -> DataFrame:
    """Lounges with the ``url`` of their page and their ``pos`` on it."""
    return lounge_rows.withColumn("pos", key.cast("long")).withColumn(
        "url", page_url(F.col("airport_code"), F.floor(F.col("pos") / PAGE_KEYS).cast("int")))


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one boarding pass per event (times as printed ``HH:mm`` strings)."""
    e = (spread(read_table(spark, sf_dir, "events"))
         .select("event_id", "ts", "user_id", "event_type",
                 F.expr("try_cast(get_json_object(props, '$.k') AS INT)").alias("k"),
                 (F.hour("ts") * 60 + F.minute("ts")).alias("mod")))
    k = F.col("k")
    eid, uid = F.col("event_id"), F.col("user_id")

    def hhmm(offset: Column) -> Column:
        # HH:mm of ts + offset minutes (whole minutes never carry the seconds)
        m = F.pmod(F.col("mod") + offset, F.lit(1440))
        return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"),
                        F.lpad((m % 60).cast("string"), 2, "0"))

    t5 = eid % 5
    terminal = F.when(t5 == 0, "1").when(t5 == 1, "2C").when(t5 == 4, "2")
    return e.select(
        eid.alias("pass_id"),
        uid.alias("user_id"),
        F.col("ts").alias("now_ts"),
        _code(uid % 25).alias("airport_code"),
        F.when(~F.col("event_type").isin("error", "view"), hhmm(30 + 3 * k)).alias("boarding"),
        F.when(F.col("event_type") != "error", hhmm(60 + 3 * k)).alias("departure"),
        terminal.alias("terminal"),
        F.when(terminal.isNotNull(), F.lit("printed")).alias("terminal_source"),
        F.when(terminal.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)).alias("terminal_confidence"),
        F.when(t5 == 2, F.lit("B12")).alias("gate"),
        F.concat(F.lit("XY"), eid.cast("string")).alias("flight_number"),
        F.when(eid % 11 != 0, _code((uid + 7) % 25)).alias("dest_iata"),
    )


# --------------------------------------------------------------------------
# Text fixtures. Each is a single SQL expression over fixture columns that both
# Spark and the DuckDB oracle evaluate, so the two engines see identical inputs.

SEP_SQL = ("CASE pass_id % 4 WHEN 0 THEN ' → ' WHEN 1 THEN ' - ' WHEN 2 THEN ' -> ' ELSE ' ' END")

# Passes are printed in four layouts: labels before values; other labels beside them; a 12-hour clock in
# sentences; a line of labels above a line of values.
_LAYOUT = "(CAST(floor(pass_id / 20) AS INT) % 4)"
_FLIGHT = "CASE WHEN pass_id % 3 = 1 THEN 'BER' ELSE 'XY' END || CAST(pass_id % 10000 AS STRING)"
_H12 = ("CAST((CAST(substr({0}, 1, 2) AS INT) + 11) % 12 + 1 AS STRING) || substr({0}, 3, 3) "
        "|| CASE WHEN CAST(substr({0}, 1, 2) AS INT) < 12 THEN ' AM' ELSE ' PM' END")
_DATED = "CASE WHEN pass_id % 8 = 5 THEN CAST(CAST(now_ts AS DATE) AS STRING) || ' ' ELSE '' END"

PASS_TEXT_SQL = f"""concat_ws(' ',
  CASE WHEN pass_id % 7 = 3 THEN 'E-TICKET' END,
  CASE {_LAYOUT} WHEN 0 THEN 'FLIGHT ' || {_FLIGHT} WHEN 1 THEN 'FLIGHT NO. ' || {_FLIGHT}
       WHEN 2 THEN 'Your flight ' || {_FLIGHT} END,
  CASE WHEN pass_id % 19 <> 7 THEN city_a || {SEP_SQL} || city_b END,
  CASE WHEN pass_id % 2 = 0 THEN 'DEP (' || chr(65 + CAST(user_id % 25 AS INT))
       || chr(65 + CAST((user_id + 7) % 25 AS INT)) || 'X)' END,
  CASE WHEN pass_id % 6 = 2 THEN 'ARR (QQZ)' END,
  CASE WHEN {_LAYOUT} = 3 THEN concat_ws(' ', 'FLIGHT', CASE WHEN terminal IS NOT NULL THEN 'TERMINAL' END,
         CASE WHEN pass_id % 5 IN (2, 3) THEN 'GATE' END, 'SEAT', CASE WHEN boarding IS NOT NULL THEN 'BOARDING' END,
         CASE WHEN departure IS NOT NULL THEN 'DEPARTURE' END) || chr(10)
       || concat_ws(' ', {_FLIGHT}, terminal, CASE pass_id % 5 WHEN 2 THEN 'B12' WHEN 3 THEN 'G7' END, '14A',
                    {_DATED} || boarding, departure) || chr(10) END,
  CASE WHEN terminal IS NOT NULL AND {_LAYOUT} < 3
       THEN CASE WHEN {_LAYOUT} = 1 THEN 'TERMINAL BUILDING ' WHEN pass_id % 2 = 0 THEN 'TERMINAL ' ELSE 'TERMINAL: ' END || terminal END,
  CASE WHEN {_LAYOUT} = 1 THEN 'GATE CLOSES 23:59' END,
  CASE WHEN {_LAYOUT} < 3 THEN CASE WHEN pass_id % 5 = 2 THEN 'GATE: B12' WHEN pass_id % 5 = 3 THEN 'Gate G7' END END,
  CASE WHEN {_LAYOUT} = 1 THEN 'ARRIVAL TIME 23:58' END,
  CASE WHEN boarding IS NOT NULL THEN CASE {_LAYOUT} WHEN 0 THEN 'BOARDING TIME ' || {_DATED} || boarding
       WHEN 1 THEN 'Boarding: ' || {_DATED} || boarding
       WHEN 2 THEN 'Boarding starts at ' || {_DATED} || {_H12.format('boarding')} END END,
  CASE WHEN departure IS NOT NULL THEN CASE {_LAYOUT} WHEN 0 THEN 'TIME ' || departure WHEN 1 THEN 'DEPARTURE TIME ' || departure
       WHEN 2 THEN 'and departs ' || {_H12.format('departure')} END END,
  CASE WHEN pass_id % 3 = 0 AND pass_id % 19 <> 7 THEN 'RETURN ' || city_b || {SEP_SQL} || city_a END)"""

JSON_TEXT_SQL = """CASE WHEN pass_id % 7 = 5 THEN 'FLIGHT XY' || CAST(pass_id % 10000 AS STRING) || ' has no JSON'
ELSE '{"airport": {"iata": "' || airport_code || '", "city": null}, '
  || '"destination": {"iata": ' || CASE WHEN dest_iata IS NULL THEN 'null' ELSE '"' || dest_iata || '"' END
  || ', "city": null, "confidence": ' || CASE WHEN pass_id % 7 = 4 THEN '"0.5"' ELSE '0.75' END || '}, '
  || '"terminal": {"value": ' || CASE WHEN terminal IS NULL THEN 'null' ELSE '"' || terminal || '"' END
  || ', "source": ' || CASE WHEN terminal IS NULL THEN 'null' ELSE '"printed"' END
  || ', "confidence": ' || CASE WHEN terminal IS NULL THEN '0.0' ELSE '1.0' END || '}, '
  || CASE WHEN pass_id % 7 = 1 THEN ''
          ELSE '"gate": ' || CASE WHEN gate IS NULL OR pass_id % 7 = 2 THEN 'null' ELSE '"' || gate || '"' END || ', ' END
  || '"flight_number": ' || CASE WHEN pass_id % 7 = 3 THEN '5' ELSE '"XY' || CAST(pass_id % 10000 AS STRING) || '"' END
  || ', "departure_time_local": ' || CASE WHEN departure IS NULL THEN 'null' ELSE '"' || departure || '"' END
  || ', "boarding_time_local": ' || CASE WHEN boarding IS NULL THEN 'null' ELSE '"' || boarding || '"' END
  || ', "raw_text": "FLIGHT XY' || CAST(pass_id % 10000 AS STRING) || '", "assumptions": '
  || CASE pass_id % 28 WHEN 0 THEN '["a", "b"]' WHEN 7 THEN 'null' WHEN 14 THEN '[1]' ELSE '[]' END || '}'
  || CASE WHEN pass_id % 7 = 6 THEN ' trailing text' ELSE '' END
END"""

MODEL_TEXT_SQL = """CASE pass_id % 4
  WHEN 0 THEN '```json' || chr(10) || '{"pass_id": ' || CAST(pass_id AS STRING) || ', "airport": "' || airport_code || '"}' || chr(10) || '```'
  WHEN 1 THEN '```' || chr(10) || '{"pass_id": ' || CAST(pass_id AS STRING) || ', "airport": "' || airport_code || '"}' || chr(10) || '```'
  WHEN 2 THEN 'Here is the result:' || chr(10) || '```json' || chr(10) || '{"pass_id": ' || CAST(pass_id AS STRING)
              || ', "airport": "' || airport_code || '"}' || chr(10) || '```' || chr(10) || 'Done.'
  ELSE '  {"pass_id": ' || CAST(pass_id AS STRING) || ', "airport": "' || airport_code || '"}  '
END"""

BARCODE_SQL = """'M1' || rpad('PAX/' || CAST(o_custkey AS STRING), 20, ' ') || 'E'
  || lpad(CAST(o_orderkey AS STRING), 7, '0')
  || 'A' || lpad(CAST(o_custkey % 25 AS STRING), 2, '0')
  || 'A' || lpad(CAST((o_custkey + 7) % 25 AS STRING), 2, '0')
  || 'XY ' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || ' '
  || CASE WHEN o_orderkey % 50 = 0 THEN 'ABC' ELSE lpad(CAST(dayofyear(o_orderdate) AS STRING), 3, '0') END
  || CASE WHEN o_orderkey % 40 = 1 THEN '' ELSE 'Y012A0001 100' END"""

EDITS_SQL = {
    "airport_iata": "airport_code",
    "airport_city": "CASE WHEN pass_id % 4 = 2 THEN ' ' ELSE 'City ' || airport_code END",
    "dest_city": "CASE WHEN pass_id % 3 = 0 THEN '' ELSE 'Town' END",
    "dest_iata": "CASE WHEN pass_id % 4 = 0 THEN '' ELSE coalesce(dest_iata, '') END",
    "terminal": "CASE WHEN pass_id % 5 = 0 THEN '' ELSE coalesce(terminal, '') END",
    "gate": "'C' || CAST(pass_id % 30 AS STRING)",
    "flight": "'XY' || CAST(pass_id % 10000 AS STRING)",
    "departure": "coalesce(departure, '')",
    "boarding": "CASE WHEN pass_id % 4 = 2 THEN '' ELSE coalesce(boarding, '') END",
}


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City names (the nation table): ``city_key``, ``city``."""
    return read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("city_key"), F.col("n_name").alias("city"))


def pass_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """printed boarding-pass text per F2 pass (cities from ``nation``)."""
    from concourse.plans.joins import sized_broadcast
    p = passes(spark, sf_dir)
    c = sized_broadcast(cities(spark, sf_dir))
    a = c.select(F.col("city_key").alias("ka"), F.col("city").alias("city_a"))
    b = c.select(F.col("city_key").alias("kb"), F.col("city").alias("city_b"))
    j = (p.join(a, (p.user_id % 25) == a.ka, "left").join(b, ((p.user_id + 7) % 25) == b.kb, "left"))
    return j.select("pass_id", F.expr(PASS_TEXT_SQL).alias("text"))


def pass_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR annotations of the printed passes: one page of one paragraph, each word as sure as the print is (every fourth
    pass is printed badly)."""
    sure = F.when(F.col("pass_id") % 4 == 0, F.lit(0.5)).otherwise(F.lit(0.875))
    words = F.transform(F.split("text", " "), lambda w: F.struct(sure.alias("confidence")))
    pages = F.array(F.struct(F.array(F.lit("en")).alias("langs"), F.array(F.struct(F.array(F.struct(words.alias("words")))
                                                                                  .alias("paragraphs"))).alias("blocks")))
    return pass_text(spark, sf_dir).select("pass_id", F.col("text").alias("full_text"), pages.alias("pages"))


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-style pass JSON with missing keys, nulls, wrong types, numeric strings,
    non-JSON and trailing text (by ``pass_id % 7``)."""
    return passes(spark, sf_dir).select("pass_id", F.expr(JSON_TEXT_SQL).alias("json_text"))


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model answers wrapped in a json fence, a bare fence, prose around a fence, or nothing."""
    return passes(spark, sf_dir).select("pass_id", F.expr(MODEL_TEXT_SQL).alias("text"))


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fixed-width barcode strings from ``orders`` (60 chars, or 47 when truncated)."""
    o = spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    return o.select(F.col("o_orderkey").alias("order_key"), F.expr(BARCODE_SQL).alias("raw"))


def ocr_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a document-text annotation per ``documents`` row: page = line, one block and
    one paragraph per page, word = space-separated token, confidence =
    ``(length(word) % 17) / 16`` (dyadic, so sums are exact)."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    pages = F.transform(F.split(F.col("text"), "\n"), lambda line: F.struct(
        F.array(F.col("lang")).alias("langs"),
        F.array(F.struct(F.array(F.struct(
            F.transform(F.split(line, " "), lambda w: F.struct(
                ((F.length(w) % 17) / 16.0).alias("confidence"))).alias("words")
        )).alias("paragraphs"))).alias("blocks")))
    return d.select("doc_id", F.col("text").alias("full_text"), pages.alias("pages"),
                    F.split(F.col("text"), "\n").alias("entities"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manual form edits for every sixth pass, some fields blank."""
    p = passes(spark, sf_dir).filter(F.col("pass_id") % 6 == 0)
    return p.select("pass_id", *[F.expr(v).alias(k) for k, v in EDITS_SQL.items()])


# --------------------------------------------------------------- page fixtures
_SLUG_SQL = ("CASE event_id % 5 WHEN 0 THEN 'united-kingdom' WHEN 1 THEN 'united-states-of-america' "
             "WHEN 2 THEN 'cote-d' || chr(39) || 'ivoire' WHEN 3 THEN '3rd-land' ELSE 'some-land' END")
_PATH_SQL = (f"CASE WHEN event_id % 9 = 0 THEN '/e' || CAST(event_id AS STRING) "
             f"ELSE '/lounges/' || {_SLUG_SQL} || '/e' || CAST(event_id AS STRING) END")
#: A region's items; the name holds a brace, quotes, an escaped letter and an escaped slash.
_NAME_SQL = "'n } ' || chr(92) || '\"q' || chr(92) || '\" ' || chr(92) || 'u00e9 ' || chr(92) || '/ ' || CAST(event_id AS STRING)"
_OBJ_SQL = (f"""'{{"R0":{{"items":[{{"url":"' || {_PATH_SQL} || '","name":"' || {_NAME_SQL} || '"}},],}},"R1":5}}'""")


def _escaped_sql(x: str) -> str:
    return f"replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"


#: Even ids hold the object as it is, odd ones in a string literal, in one inside another, or behind quotes.
EMBEDDED_HTML_SQL = (
    "'<html><head><script>var a = 0;</script><script>var s=1; x[' "
    "|| CASE WHEN event_id % 13 = 0 THEN 'other' ELSE 'regionData' END || '] : ' "
    f"|| CASE event_id % 6 WHEN 1 THEN {_escaped_sql(_OBJ_SQL)} WHEN 3 THEN {_escaped_sql(_escaped_sql(_OBJ_SQL))} "
    f"WHEN 5 THEN chr(34) || {_escaped_sql(_OBJ_SQL)} || chr(34) ELSE {_OBJ_SQL} END "
    "|| '; done(' || chr(34) || 'x' || chr(34) || ');</script></head><body></body></html>'")

# Cards and amenity blocks in four layouts each: attributes before and after, single quotes, ``>`` in a value,
# further levels of nesting, entities, end tags left out.
CARD_SQL = """CASE k % 4
    WHEN 1 THEN '<li class="c" data-n="1"><div><div>' WHEN 2 THEN '<li><!-- <a href="/no"> --><span class="x">' ELSE '<li>' END
  || CASE WHEN k % 29 = 0 THEN '<a class="k" data-href="/no">'
          WHEN k % 4 = 1 THEN '<a class="k" href="' || detail_url || '" rel=next>'
          WHEN k % 4 = 2 THEN '<a title="a > b" href=' || chr(39) || replace(detail_url, '/', '&#47;') || chr(39) || '>'
          ELSE '<a href="' || detail_url || '">' END
  || CASE WHEN k % 23 = 0 THEN ''
          WHEN k % 4 = 1 THEN '<div><h4 class="t"><span> ' || name || '</span> <b>&amp;</b> Bar </h4></div>'
          WHEN k % 4 = 2 THEN '<h4>' || name || '&nbsp;</h4>'
          ELSE '<h4> ' || name || ' </h4>' END
  || CASE WHEN terminal IS NULL THEN '<p data-testid="other">9</p>'
          WHEN k % 4 = 1 THEN '<div><p class="x" data-testid="outlet-card-terminal"><i>' || terminal || '</i></p></div>'
          WHEN k % 4 = 3 THEN '<p data-testid=outlet-card-terminal>' || terminal
          ELSE '<p data-testid="outlet-card-terminal">' || terminal || '</p>' END
  || CASE WHEN opening_hours = 'N/A' THEN '<p><b>Hours: none</b></p>'
          WHEN k % 4 = 1 THEN '<div><p class="h">Hours: <span>' || opening_hours || '</span></p></div>'
          ELSE '<p>Hours: ' || opening_hours || '</p>' END
  || CASE WHEN image_url = '' THEN ''
          WHEN k % 4 = 1 THEN '<img alt="Hours: > 9" src=' || chr(39) || image_url || chr(39) || '>'
          ELSE '<img src="' || image_url || '"/>' END
  || CASE k % 4 WHEN 1 THEN '</a></div></div></li>' WHEN 3 THEN '</a>' ELSE '</a></li>' END"""

_AMENITY_SQL = """CASE k % 5
  WHEN 0 THEN ''
  WHEN 1 THEN '<p class="am"><span>Wi-Fi</span></p>'
  WHEN 2 THEN '<p data-x="1" class="am big"><span>Showers</span><i>Free</i><i>24h</i></p><p class="am"><span>Bar &amp; Grill</span></p>'
  WHEN 3 THEN '<p class="am"><i>Orphan</i></p><p class="am"><b><span class="n"> Quiet <em>room</em> </span></b><u><i>Adults</i></u></p><p class="amx"><span>no</span></p>'
  ELSE '<p class="am"><span>Spa</span><i>Paid</i></p><p class="am"><span>Food</span><i>Hot</i><i>Cold</i></p><p class="am"><span>News</span></p>'
END"""
_LOC_ITEMS_SQL = """CASE k % 4
  WHEN 0 THEN ''
  WHEN 1 THEN '<li> Gate area A </li>'
  WHEN 2 THEN '<li> Gate area A </li><li>' || CASE WHEN k % 9 = 0 THEN '  ' ELSE ' Level 2 ' END || '</li>'
  ELSE '<li> Gate area A </li><li>' || CASE WHEN k % 9 = 0 THEN '  ' ELSE ' Level 2 ' END || '</li><li> Near security </li>'
END"""
_COND_ITEMS_SQL = """CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '<li>Max 3 hours</li>'
  ELSE '<li>Max 3 hours</li><li> </li><li>No children</li>' END"""
DETAIL_HTML_SQL = f"""'<html><body><div class="facilities">' || {_AMENITY_SQL} || '</div>'
  || CASE WHEN k % 2 = 0
          THEN '<button aria-expanded="false"><h2>Location</h2></button><div><ul>' || {_LOC_ITEMS_SQL} || '</ul></div>'
          ELSE '<h2>Location</h2><div><ul>' || {_LOC_ITEMS_SQL} || '</ul></div>' END
  || '<button aria-expanded="true"><h2>Conditions</h2></button><div><ul>' || {_COND_ITEMS_SQL} || '</ul></div>'
  || '</body></html>'"""


def embedded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one page per event whose second script embeds the region map after
    ``regionData`` (brace and quotes inside a string, trailing commas, a scalar region,
    trailing code; escaped once or twice for odd ids; key absent when id % 13 = 0)."""
    e = spread(read_table(spark, sf_dir, "events").select("event_id"))
    return e.select(F.col("event_id").alias("page_id"), F.expr(EMBEDDED_HTML_SQL).alias("html"))


def _lounges_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = spread(lounges(spark, sf_dir))
    return lo.withColumn("k", F.substring("lounge_id", 2, 9).cast("long"))


def lounge_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7c: one card snippet per F1 lounge (some without href or heading)."""
    lo = _lounges_k(spark, sf_dir)
    return lo.select("airport_code", "k", F.expr(CARD_SQL).alias("card"))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7b: a detail page per F1 lounge, keyed by its detail URL; none when k % 10 = 0."""
    lo = _lounges_k(spark, sf_dir).filter(F.col("k") % 10 != 0)
    return lo.select(F.col("detail_url").alias("url"), F.expr(DETAIL_HTML_SQL).alias("html"))


def airport_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled airport pages (page_id, url, html): header elements and the page's lounge cards
    in order, about 500 to a page; one empty page per airport without lounges."""
    last = read_table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0
    heads = catalog_pages(airports(spark, sf_dir).select("airport_code", "airport_name", "airport_location"), last)
    cards = on_pages(lounge_cards(spark, sf_dir), F.col("k")).groupBy("url").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "card"))), lambda x: x["card"]), "").alias("cards"))

    def element(name: str) -> Column:
        return F.concat(F.lit(f'<p data-testid="{name.replace("_", "-")}"> '), F.col(name), F.lit(" </p>"))

    return heads.join(cards, "url", "left").select(
        F.xxhash64("url").alias("page_id"), "url",
        F.concat(F.lit("<html><body>"), element("airport_name"), element("airport_code"), element("airport_location"),
                 F.lit("<ul>"), F.coalesce("cards", F.lit("")), F.lit("</ul></body></html>")).alias("html"))
