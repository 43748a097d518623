"""Boarding-pass text -> structured record.

The reference leaves these rules to a language model; here they are deterministic
expressions over *printed* text only — nothing is invented. Unmarked layouts fall
back to a documented inference with confidence < 1 and an assumption.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concourse.operators.labels import as_printed, bound_values
from concourse.operators.ocr import ws_trim
from concourse.operators.recommend import gate_core
from concourse.plans.joins import sized_broadcast

# Fixed patterns of the printed layouts.
IATA_RE = r"\(([A-Z]{3})\)"
ARRIVAL_IATA_RE = r"(?i)\b(?:ARR|ARRIVAL|DEST|DESTINATION|TO)\.?\s*:?\s*\(([A-Za-z]{3})\)"
#: Words, codes in brackets and direction markers. A plain hyphen is a marker only between blanks, so that hyphenated words are none.
ROUTE_TOKEN_RE = r"→|->|(?<=\s)[–-](?=\s)|\([A-Z]{3}\)|[\p{L}\p{N}_']+(?:[-.][\p{L}\p{N}_']+)*"
ROUTE_WORD_RE = r"^[\p{L}\p{N}]"
MARKERS = ["→", "->", "–", "-"]
FLIGHT_DETAILS = ["FLIGHT", "GATE", "BOARDING", "SEAT"]
INFERRED_CONFIDENCE = 0.5
A_ROUTE_INFERRED = "No direction marker; route inferred from the cities nearest to the flight details."

JSON_FENCE_ANCHORED = [(r"^```json\s*", ""), (r"^```\s*", ""), (r"\s*```$", "")]
FENCE_BLOCK_RE = r"```(?:json)?\s*([\s\S]*?)```"


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# ---------------------------------------------------------------- fences
def strip_code_fence(df: DataFrame, text: str = "text") -> DataFrame:
    """(a) ``anchored``: strip an opening/closing fence at the ends; (b) ``extracted``:
    the first fenced block anywhere, else the whole text. Both trimmed."""
    a = ws_trim(F.col(text))
    for pat, rep in JSON_FENCE_ANCHORED:
        a = F.regexp_replace(a, pat, rep)
    has_block = F.col(text).rlike(FENCE_BLOCK_RE)
    b = F.when(has_block, ws_trim(F.regexp_extract(F.col(text), FENCE_BLOCK_RE, 1))).otherwise(ws_trim(F.col(text)))
    return df.withColumn("anchored", ws_trim(a)).withColumn("extracted", b)


# --------------------------------------------------------- json contract
STRING_KEYS = ["gate", "flight_number", "departure_time_local", "boarding_time_local", "raw_text"]
NESTED = {"airport": (["iata", "city"], []),
          "destination": (["iata", "city"], ["confidence"]),
          "terminal": (["value", "source"], ["confidence"])}


def json_contract(df: DataFrame, text: str = "json_text") -> DataFrame:
    """Text -> typed pass fields, or a ``reject_reason``.

    Valid JSON with exactly one top-level object (trailing text rejected); every
    key present (null allowed); string fields must be strings; confidences are numbers or
    numeric strings and ``assumptions`` an array of strings, each with a default (0.0, [])
    only when its key is absent: null is no value for them."""
    s = F.col(text)
    v = F.expr(f"try_parse_json(`{text}`)")
    single = F.expr(f"json_array_length(concat('[', `{text}`, ']'))") == 1
    keys = F.expr(f"json_object_keys(`{text}`)")
    out = df.withColumn("_v", v).withColumn("_keys", keys).withColumn("_single", single)

    def typ(path: str) -> Column:
        return F.expr(f"schema_of_variant(variant_get(_v, '{path}'))")

    reasons = [F.when(F.col("_v").isNull() | ~F.coalesce(F.col("_single"), F.lit(False))
                      | F.col("_keys").isNull(), F.lit("not JSON"))]
    for k in list(NESTED) + STRING_KEYS:
        reasons.append(F.when(~F.array_contains(F.col("_keys"), k), F.lit(f"missing {k}")))
    for parent, (req, _opt) in NESTED.items():
        sub = F.expr(f"json_object_keys(get_json_object(`{text}`, '$.{parent}'))")
        for k in req:
            reasons.append(F.when(~F.coalesce(F.array_contains(sub, k), F.lit(False)),
                                  F.lit(f"missing {parent}.{k}")))
            reasons.append(F.when(~typ(f"$.{parent}.{k}").isin("STRING", "VOID"),
                                  F.lit(f"{parent}.{k} is not a string")))
    for k in STRING_KEYS:
        reasons.append(F.when(~typ(f"$.{k}").isin("STRING", "VOID"), F.lit(f"{k} is not a string")))
    for parent in ("destination", "terminal"):
        t = typ(f"$.{parent}.confidence")
        num = t.isin("BIGINT", "DOUBLE") | t.startswith("DECIMAL")
        str_num = (t == "STRING") & F.expr(f"try_variant_get(_v, '$.{parent}.confidence', 'double')").isNotNull()
        reasons.append(F.when(t.isNotNull() & ~(num | str_num), F.lit(f"{parent}.confidence is not a number")))
    t = typ("$.assumptions")
    texts = F.expr("try_variant_get(_v, '$.assumptions', 'array<variant>')")
    all_text = F.forall(texts, lambda x: F.call_function("schema_of_variant", x) == "STRING")
    reasons.append(F.when(t.isNotNull() & ~F.coalesce(t.startswith("ARRAY") & all_text, F.lit(False)),
                          F.lit("assumptions is not an array of strings")))
    reason = F.coalesce(*reasons)
    out = out.withColumn("reject_reason", reason)
    ok = F.col("reject_reason").isNull()

    def sget(path: str) -> Column:
        return F.when(ok, F.expr(f"try_variant_get(_v, '{path}', 'string')"))

    def conf(path: str) -> Column:
        return F.when(ok, F.coalesce(F.expr(f"try_variant_get(_v, '{path}', 'double')"), F.lit(0.0)))

    return (out.select(
        "*", ok.alias("valid"),
        sget("$.airport.iata").alias("airport_iata"), sget("$.airport.city").alias("airport_city"),
        sget("$.destination.iata").alias("dest_iata"), sget("$.destination.city").alias("dest_city"),
        conf("$.destination.confidence").alias("dest_confidence"),
        sget("$.terminal.value").alias("terminal_value"), sget("$.terminal.source").alias("terminal_source"),
        conf("$.terminal.confidence").alias("terminal_confidence"),
        sget("$.gate").alias("gate"), sget("$.flight_number").alias("flight_number"),
        sget("$.departure_time_local").alias("departure_time_local"),
        sget("$.boarding_time_local").alias("boarding_time_local"),
        F.when(ok, F.coalesce(F.expr("try_variant_get(_v, '$.assumptions', 'array<string>')"),
                              F.array().cast("array<string>"))).alias("assumptions"))
        .drop("_v", "_keys", "_single"))


# ----------------------------------------------------------- extraction
def _route_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit(ROUTE_TOKEN_RE), F.lit(0))


def city_mentions(df: DataFrame, cities: DataFrame, text: str = "text", key: str = "pass_id") -> DataFrame:
    """(key, start, end, city) of every place at which a known city's name stands, in tokens. Runs of up to as many words
    as the longest name has are joined with the names: the work does not grow with the number of cities."""
    names = cities.select(F.col("city"), _route_tokens(F.col("city")).alias("words")).filter(F.size("words") > 0)
    names = names.select(F.array_join("words", " ").alias("run"), "city", F.size("words").alias("n")) \
        .groupBy("run").agg(F.min("city").alias("city"), F.first("n").alias("n"))
    longest = names.agg(F.max("n")).first()[0]
    if longest is None:
        return df.select(key, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("city")).limit(0)
    tokens = df.select(key, _route_tokens(F.col(text)).alias("tokens"))
    at = tokens.select(key, "tokens", F.posexplode("tokens").alias("start", "first")).filter(F.col("first").rlike(ROUTE_WORD_RE))
    runs = at.select(key, "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("tokens") - F.col("start")))).alias("n"), "tokens")
    runs = runs.select(key, "start", (F.col("start") + F.col("n")).alias("end"),
                       F.array_join(F.slice("tokens", F.col("start") + 1, F.col("n")), " ").alias("run"))
    return runs.join(sized_broadcast(names.select("run", "city")), "run").select(key, "start", "end", "city")


def extract_route(df: DataFrame, cities: DataFrame, text: str = "text", key: str = "pass_id") -> DataFrame:
    """First directional pair ``A -> B`` of known cities (``cities.city``): A departs, B is the
    destination; later mentions are ignored. A city may be followed by its printed code.
    Without such a pair, the two known cities nearest to the flight details, in reading order,
    with confidence 0.5 and an assumption. Only the few mentions of a text are dealt out by ``key``, which names a text."""
    found = city_mentions(df, cities, text, key).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "city"))).alias("_found"))
    d = df.join(found, key, "left").withColumn("_tokens", _route_tokens(F.col(text)))
    places = F.filter(F.transform("_tokens", lambda t, i: F.when(t.isin(FLIGHT_DETAILS), i)), lambda i: i.isNotNull())
    marks = F.filter(F.transform("_tokens", lambda t, i: F.when(t.isin(MARKERS), i)), lambda i: i.isNotNull())
    d = d.withColumns({"_found": F.coalesce("_found", F.array().cast("array<struct<start:int,end:int,city:string>>")),
                       "_places": places, "_marks": marks})

    def longest(ms: Column) -> Column:
        return F.get(F.sort_array(F.transform(ms, lambda m: F.struct((m["end"] - m["start"]).alias("n"), m["city"].alias("city"))), False), 0)["city"]

    def pair(i: Column) -> Column:
        coded = F.coalesce(F.get("_tokens", i - 1).startswith("("), F.lit(False))
        before = F.when(coded, i - 1).otherwise(i)
        return F.struct(longest(F.filter("_found", lambda m: m["end"] == before)).alias("a"),
                        longest(F.filter("_found", lambda m: m["start"] == i + 1)).alias("b"))

    pairs = F.filter(F.transform("_marks", pair), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    d = d.withColumn("_marked", F.get(pairs, 0))
    # each city's first place, without those inside a longer city's
    alone = F.filter("_found", lambda m: ~F.exists("_found", lambda o: (o["start"] <= m["start"]) & (o["end"] >= m["end"])
                                                   & ((o["end"] - o["start"]) > (m["end"] - m["start"]))))
    once = F.filter(alone, lambda m: ~F.exists("_found", lambda o: (o["city"] == m["city"]) & (o["start"] < m["start"])))

    def distance(m: Column) -> Column:
        far = F.transform("_places", lambda p: F.when(p >= m["end"], p - m["end"] + 1).otherwise(m["start"] - p))
        return F.struct(F.coalesce(F.array_min(far), F.lit(0)).alias("far"), m["start"].alias("start"), m["city"].alias("city"))

    near = F.slice(F.sort_array(F.transform(once, distance)), 1, 2)
    d = d.withColumn("_near", F.when(F.col("_marked").isNull(), F.sort_array(F.transform(
        near, lambda m: F.struct(m["start"].alias("start"), m["city"].alias("city"))))))
    marked, inferred = F.col("_marked").isNotNull(), F.coalesce(F.size("_near") == 2, F.lit(False))
    return d.select(
        key,
        F.when(marked, F.col("_marked.a")).when(inferred, F.get("_near", F.lit(0))["city"]).alias("dep_city"),
        F.when(marked, F.col("_marked.b")).when(inferred, F.get("_near", F.lit(1))["city"]).alias("dest_city"),
        F.when(marked, F.lit("marked")).when(inferred, F.lit("inferred")).alias("route_source"),
        F.when(marked, F.lit(1.0)).when(inferred, F.lit(INFERRED_CONFIDENCE)).otherwise(F.lit(0.0))
        .alias("route_confidence"),
        F.when(~marked & inferred, F.lit(A_ROUTE_INFERRED)).alias("route_assumption"),
        *[c for c in df.columns if c != key])


def extract_iata(df: DataFrame, text: str = "text") -> DataFrame:
    """Codes printed as ``(XXX)``; never looked up or invented. A code after an arrival label is the
    destination's; of the others the first departs and the second is the destination."""
    labelled = _nz(F.regexp_extract(F.col(text), ARRIVAL_IATA_RE, 1))
    codes = F.regexp_extract_all(F.regexp_replace(F.col(text), ARRIVAL_IATA_RE, " "), F.lit(IATA_RE), F.lit(1))
    return (df.withColumn("_codes", codes)
            .withColumn("dep_iata", F.get("_codes", 0))
            .withColumn("dest_iata", F.coalesce(F.upper(labelled), F.get("_codes", 1))).drop("_codes"))


def with_labels(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_printed``, the values bound to their labels; read once for all rules below."""
    return df if "_printed" in df.columns else df.withColumn("_printed", bound_values(F.col(text)))


def extract_times(df: DataFrame, text: str = "text") -> DataFrame:
    """Labelled boarding time -> boarding; labelled departure, else a generic ``TIME`` or a time behind the flight ->
    departure; with the date where one is printed, 12-hour clocks as 24-hour ones."""
    d, printed = with_labels(df, text), F.col("_printed")
    return d.withColumn("boarding_time", as_printed(printed["boarding"])) \
        .withColumn("departure_time", as_printed(F.coalesce(printed["departure"], printed["time"])))


def extract_flight_gate(df: DataFrame, text: str = "text") -> DataFrame:
    """Flight code verbatim; gate without its ``Gate``/``G`` prefix."""
    d, printed = with_labels(df, text), F.col("_printed")
    return d.withColumn("flight_number", printed["flight"]).withColumn("gate", gate_core(printed["gate"]))


def extract_terminal(df: DataFrame, text: str = "text", gate: str = "gate") -> DataFrame:
    """Printed -> (value, printed, 1.0); else the gate's leading letters ->
    (value, inferred, 0.5) + assumption; else (null, null, 0.0)."""
    letters = _nz(F.regexp_extract(F.upper(F.col(gate)), r"^([A-Z]+)\d", 1))
    out = with_labels(df, text).withColumn("_tp", F.col("_printed")["terminal"]).withColumn("_tl", letters)
    tp, tl = F.col("_tp"), F.col("_tl")
    return (out.withColumn("terminal_value", F.coalesce(tp, tl))
            .withColumn("terminal_source", F.when(tp.isNotNull(), "printed").when(tl.isNotNull(), "inferred"))
            .withColumn("terminal_confidence", F.when(tp.isNotNull(), F.lit(1.0))
                        .when(tl.isNotNull(), F.lit(INFERRED_CONFIDENCE)).otherwise(F.lit(0.0)))
            .withColumn("terminal_assumption", F.when(tp.isNull() & tl.isNotNull(), F.concat(
                F.lit("Terminal inferred as "), tl, F.lit(" from gate "), F.col(gate), F.lit("."))))
            .drop("_tp", "_tl"))


def parse_pass_text(df: DataFrame, cities: DataFrame, text: str = "text", key: str = "pass_id") -> DataFrame:
    """All extraction rules composed: one pass record per text row."""
    base = extract_terminal(extract_flight_gate(extract_times(extract_iata(with_labels(df, text), text), text), text), text).drop("_printed")
    rec = extract_route(base, cities, text, key)
    assumptions = F.filter(F.array(F.col("terminal_assumption"), F.col("route_assumption")),
                           lambda x: x.isNotNull())
    return rec.withColumn("assumptions", assumptions)


def pass_record(parsed: DataFrame, text: str = "text", key: str = "pass_id") -> DataFrame:
    """Parsed texts as the nested boarding-pass record, with city, code and confidence of both
    ends."""
    return parsed.select(
        key,
        F.struct(F.col("dep_iata").alias("iata"), F.col("dep_city").alias("city"),
                 F.col("route_confidence").alias("confidence")).alias("airport"),
        F.struct(F.col("dest_iata").alias("iata"), F.col("dest_city").alias("city"),
                 F.col("route_confidence").alias("confidence")).alias("destination"),
        F.struct(F.col("terminal_value").alias("value"), F.col("terminal_source").alias("source"),
                 F.col("terminal_confidence").alias("confidence")).alias("terminal"),
        "gate", "flight_number", F.col("departure_time").alias("departure_time_local"),
        F.col("boarding_time").alias("boarding_time_local"), F.col(text).alias("raw_text"), "assumptions")


def confidence_violations(parsed: DataFrame) -> DataFrame:
    """Invariant: an inferred value has confidence < 1 and an assumption; a missing
    one has confidence 0. Returns counts per (field, source) and the violations."""
    def one(field: str) -> Column:
        return F.struct(F.lit(field).alias("field"), F.col(f"{field}_source").alias("source"),
                        F.col(f"{field}_confidence").alias("conf"), F.col(f"{field}_assumption").alias("note"))

    u = parsed.select(F.explode(F.array(one("terminal"), one("route"))).alias("u")).select("u.*")
    bad = (((F.col("source") == "inferred") & ((F.col("conf") >= 1.0) | F.col("note").isNull()))
           | (F.col("source").isNull() & (F.col("conf") != 0.0)))
    return u.groupBy("field", F.coalesce("source", F.lit("none")).alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_violations"))


EDIT_FIELDS = ["airport_iata", "airport_city", "dest_iata", "dest_city", "terminal", "gate", "flight", "departure",
               "boarding"]


def apply_manual_edits(parsed: DataFrame, edits: DataFrame, key: str = "pass_id") -> DataFrame:
    """The nine form fields overlay the parsed pass (left join): blank -> null, an edited
    destination has confidence 0.99 if it is given and 0.0 if not, a terminal ``printed``/0.99 when
    given else null/0.0, assumptions are reset to []. Passes without an edit row keep their
    parsed values. Fields that a side lacks are null."""
    def of(df: DataFrame, name: str, kind: str = "string") -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    e = edits.select(key, *[of(edits, c).alias(f"e_{c}") for c in EDIT_FIELDS], F.lit(True).alias("_edited"))
    names = {"airport_iata": "airport_code", "terminal": "terminal", "flight": "flight_number"}
    p = parsed.select(
        key, *[of(parsed, names.get(c, c)).alias(f"p_{c}") for c in EDIT_FIELDS],
        of(parsed, "terminal_source").alias("p_source"), of(parsed, "terminal_confidence", "double").alias("p_terminal_c"),
        F.coalesce(of(parsed, "dest_confidence", "double"),
                   F.when(of(parsed, "dest_iata").isNotNull(), 1.0).otherwise(0.0)).alias("p_dest_c"),
        F.coalesce(of(parsed, "assumptions", "array<string>"), F.array().cast("array<string>")).alias("p_assumptions"))
    j = p.join(e, key, "left")
    ed = F.coalesce(F.col("_edited"), F.lit(False))

    def pick(field: str) -> Column:
        return F.when(ed, _nz(F.trim(F.col(f"e_{field}")))).otherwise(F.col(f"p_{field}"))

    def given(*fields: str) -> Column:
        return F.coalesce(*[_nz(F.trim(F.col(f"e_{f}"))) for f in fields]).isNotNull()

    return j.select(
        key, ed.alias("edited"), *[pick(c).alias(n) for c, n in (
            ("airport_iata", "airport_iata"), ("airport_city", "airport_city"), ("dest_iata", "dest_iata"),
            ("dest_city", "dest_city"), ("terminal", "terminal_value"), ("gate", "gate"), ("flight", "flight_number"),
            ("departure", "departure"), ("boarding", "boarding"))],
        F.when(ed, F.when(given("dest_iata", "dest_city"), 0.99).otherwise(0.0)).otherwise(F.col("p_dest_c"))
        .alias("dest_confidence"),
        F.when(ed, F.when(given("terminal"), F.lit("printed"))).otherwise(F.col("p_source")).alias("terminal_source"),
        F.when(ed, F.when(given("terminal"), 0.99).otherwise(0.0)).otherwise(F.col("p_terminal_c"))
        .alias("terminal_confidence"),
        F.when(ed, F.array().cast("array<string>")).otherwise(F.col("p_assumptions")).alias("assumptions"))
