"""Barcode, JSON contract, fences, OCR and pass-text goldens (FIXTURES part C)."""

import datetime as dt

from concourse.operators import ocr
from concourse.operators import passes as pt


def bcbp(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    return {r.id: r for r in ocr.bcbp_fields(df, year=2024).collect()}


def _raw(day="032", number="0123", carrier="XY ", tail="Y012A0001 100"):
    return "M1" + "PAX/1".ljust(20) + "E" + "0000001" + "LHR" + "JFK" + carrier + number + " " + day + tail


def test_bcbp_goldens(spark):
    base = _raw()
    r = bcbp(spark, [base, base[:50], base[:51], _raw(day="000"), _raw(day="366"), _raw(day="999"),
                     _raw(day="ABC"), _raw(number="0000"), _raw(carrier="   ")])
    assert (r[0].airport_iata, r[0].destination, r[0].flight_number, r[0].date) == \
        ("LHR", "JFK", "XY123", dt.date(2024, 2, 1))
    assert r[1].airport_iata is None and r[1].raw == base[:50]      # 50 chars: all null, raw kept
    assert r[2].airport_iata == "LHR"                                # 51 chars decode
    assert r[3].date == dt.date(2023, 12, 31)                        # day 0 -> prior year
    assert r[4].date == dt.date(2024, 12, 31)                        # 2024 is a leap year
    assert r[5].date == dt.date(2026, 9, 25)                         # no range check
    assert r[6].airport_iata is None and r[6].flight_number is None  # bad day: all null
    assert r[7].flight_number == "XY"                                # number 0000
    assert r[8].flight_number == "123"                               # blank carrier


def contract(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pass_id int, json_text string")
    return {r.pass_id: r for r in pt.json_contract(df).collect()}


FULL = ('{"airport": {"iata": "LHR", "city": null}, "destination": {"iata": null, "city": "Paris", '
        '"confidence": %s}, "terminal": {"value": "5", "source": "printed", "confidence": 1}, '
        '"gate": %s, "flight_number": %s, "departure_time_local": null, "boarding_time_local": "10:00", '
        '"raw_text": "x"%s}')


def test_json_contract_goldens(spark):
    r = contract(spark, [
        FULL % ("0.9", '"B2"', '"BA1"', ', "assumptions": ["a"]'),
        FULL % ("0.9", "null", '"BA1"', ""),                # null allowed, assumptions default
        FULL.replace('"gate": %s, ', "") % ("0.9", '"BA1"', ""),  # key missing
        FULL % ("0.9", '"B2"', "5", ""),                    # int where string expected
        FULL % ('"0.5"', '"B2"', '"BA1"', ""),              # numeric string for a float
        (FULL % ("0.9", '"B2"', '"BA1"', "")) + " trailing",
        "[" + (FULL % ("0.9", '"B2"', '"BA1"', "")) + "]",   # array at top level
        "not json at all",
    ])
    assert r[0].valid and r[0].gate == "B2" and r[0].assumptions == ["a"] and r[0].terminal_confidence == 1.0
    assert r[1].valid and r[1].gate is None and r[1].assumptions == []
    assert r[2].reject_reason == "missing gate"
    assert r[3].reject_reason == "flight_number is not a string"
    assert r[4].valid and r[4].dest_confidence == 0.5
    assert r[5].reject_reason == "not JSON" and r[6].reject_reason == "not JSON" and r[7].reject_reason == "not JSON"


def test_fences(spark):
    df = spark.createDataFrame([(1, '```json\n{"a": 1}\n```'), (2, 'Sure:\n```\n{"a": 2}\n```\nbye'),
                                (3, ' {"a": 3} ')], "pass_id int, text string")
    r = {x.pass_id: x for x in pt.strip_code_fence(df).collect()}
    assert r[1].anchored == '{"a": 1}' and r[1].extracted == '{"a": 1}'
    assert r[2].anchored.startswith("Sure:") and r[2].extracted == '{"a": 2}'
    assert r[3].anchored == '{"a": 3}' == r[3].extracted


def test_ocr_no_words_and_gate(spark):
    schema = ("doc_id int, pages array<struct<langs:array<string>,blocks:array<struct<paragraphs:"
              "array<struct<words:array<struct<confidence:double>>>>>>>>")
    rows = [(1, []), (2, [(["en"], [([([(0.5,), (0.9,)],)],)])]), (3, [(["de"], [([([(0.7,)],)],)])])]
    df = ocr.confidence_gate(ocr.ocr_language(ocr.ocr_confidence(spark.createDataFrame(rows, schema))))
    r = {x.doc_id: x for x in df.collect()}
    assert r[1].ocr_confidence == 0.0 and r[1].language == "unknown" and r[1].needs_manual_edit
    assert r[2].ocr_confidence == 0.7 and not r[2].needs_manual_edit  # exactly 0.7 -> gate false
    assert r[3].language == "de"


def test_pass_text_rules(spark):
    cities = spark.createDataFrame([(0, "PARIS"), (1, "OSLO")], "city_key long, city string")
    df = spark.createDataFrame([
        (1, "FLIGHT BA12 PARIS → OSLO DEP (CDG) Gate G7 BOARDING TIME 9:40 TIME 10:10 RETURN OSLO → PARIS"),
        (2, "FLIGHT BA13 PARIS OSLO GATE B12 TIME 11:00"),
        (3, "FLIGHT BA14 TERMINAL 2C GATE B12"),
    ], "pass_id long, text string")
    r = {x.pass_id: x for x in pt.parse_pass_text(df, cities).collect()}
    assert (r[1].dep_city, r[1].dest_city, r[1].route_source) == ("PARIS", "OSLO", "marked")
    assert r[1].dep_iata == "CDG" and r[1].gate == "7" and r[1].boarding_time == "9:40"
    assert r[1].departure_time == "10:10" and r[1].flight_number == "BA12"
    assert (r[2].route_source, r[2].route_confidence) == ("inferred", 0.5) and r[2].assumptions
    assert r[2].boarding_time is None and r[2].departure_time == "11:00"
    assert (r[2].terminal_value, r[2].terminal_source, r[2].terminal_confidence) == ("B", "inferred", 0.5)
    assert (r[3].terminal_value, r[3].terminal_source) == ("2C", "printed")


def parsed(spark, texts):
    cities = spark.createDataFrame([(i, c) for i, c in enumerate(["PARIS", "OSLO", "NEW YORK", "YORK", "LOS ANGELES", "Saint-Denis"])],
                                   "city_key long, city string")
    df = spark.createDataFrame(list(enumerate(texts)), "pass_id long, text string")
    return [r for r in pt.parse_pass_text(df, cities).orderBy("pass_id").collect()]


def test_route_rules(spark):
    r = parsed(spark, [
        "FLIGHT BER167 NEW YORK → LOS ANGELES",
        "E-TICKET PARIS → OSLO",
        "PARIS (CDG) → OSLO (OSL) GATE: B2 TERMINAL: 2",
        "E-TICKET SAINT-DENIS - YORK",
        "ROME → OSLO",                                        # not a known city: no confident guess
        "OSLO NOTE ABOUT SOMETHING PARIS NEW YORK GATE B1",   # the two nearest to the details
        "PARIS -> OSLO THEN OSLO -> PARIS",
        "NOTHING HERE", "",
    ])
    assert [(x.dep_city, x.dest_city, x.route_source, x.route_confidence) for x in r] == [
        ("NEW YORK", "LOS ANGELES", "marked", 1.0), ("PARIS", "OSLO", "marked", 1.0), ("PARIS", "OSLO", "marked", 1.0),
        ("Saint-Denis", "YORK", "marked", 1.0), (None, None, None, 0.0), ("PARIS", "NEW YORK", "inferred", 0.5),
        ("PARIS", "OSLO", "marked", 1.0), (None, None, None, 0.0), (None, None, None, 0.0)]
    assert r[0].flight_number == "BER167"
    assert (r[2].dep_iata, r[2].dest_iata, r[2].gate, r[2].terminal_value) == ("CDG", "OSL", "B2", "2")
    assert r[5].assumptions and not r[6].assumptions


def test_times_with_dates_and_labels(spark):
    r = parsed(spark, ["BOARDING TIME 2024-05-01 09:40 TIME 10:10", "Boarding time: 9:05", "TIME: 2024-05-01T23:00",
                       "DEP (CDG) ARR (OSL)", "ARR (OSL)", "TERMINAL GATE: C4"])
    assert (r[0].boarding_time, r[0].departure_time) == ("2024-05-01 09:40", "10:10")
    assert (r[1].boarding_time, r[1].departure_time) == ("9:05", None)
    assert r[2].departure_time == "2024-05-01T23:00"
    assert [(x.dep_iata, x.dest_iata) for x in r[3:5]] == [("CDG", "OSL"), (None, "OSL")]
    assert (r[5].gate, r[5].terminal_value, r[5].terminal_source) == ("C4", "C", "inferred")


def test_contract_types_are_strict(spark):
    r = contract(spark, [FULL % ("null", '"B2"', '"BA1"', ""), FULL % ("1", '"B2"', '"BA1"', ', "assumptions": null'),
                         FULL % ("1", '"B2"', '"BA1"', ', "assumptions": "oops"'), FULL % ("1", '"B2"', '"BA1"', ', "assumptions": [1, 2]'),
                         FULL % ("1", '"B2"', '"BA1"', ', "assumptions": []'), (FULL % ("1", '"B2"', '"BA1"', "")).replace(', "confidence": 1}', "}")])
    assert r[0].reject_reason == "destination.confidence is not a number"
    assert {r[i].reject_reason for i in (1, 2, 3)} == {"assumptions is not an array of strings"}
    assert r[4].valid and r[4].assumptions == [] and r[5].valid


def test_edits_overlay_nine_fields(spark):
    p = spark.createDataFrame([(1, "LHR", "JFK", "5", "printed", 1.0, "A1", "BA1", "10:00", "09:00", ["note"]),
                               (2, "LHR", None, None, None, 0.0, None, None, None, None, ["note"])],
                              "pass_id long, airport_code string, dest_iata string, terminal string, terminal_source string, "
                              "terminal_confidence double, gate string, flight_number string, departure string, boarding string, "
                              "assumptions array<string>")
    e = spark.createDataFrame([(2, "CDG", "Paris", " ", "", "", "B2", "AF1", "11:00", "")],
                              "pass_id long, airport_iata string, airport_city string, dest_iata string, dest_city string, "
                              "terminal string, gate string, flight string, departure string, boarding string")
    r = {x.pass_id: x for x in pt.apply_manual_edits(p, e).collect()}
    assert (r[1].edited, r[1].dest_confidence, r[1].assumptions, r[1].airport_city) == (False, 1.0, ["note"], None)
    assert (r[2].airport_iata, r[2].airport_city, r[2].dest_iata, r[2].dest_confidence) == ("CDG", "Paris", None, 0.0)
    assert (r[2].terminal_source, r[2].terminal_confidence, r[2].assumptions, r[2].boarding) == (None, 0.0, [], None)


def test_oracles_do_not_import_the_rules():
    from pathlib import Path
    import concourse.oracle.text as text
    for name in ("text.py", "streaming.py", "serving.py"):
        assert "concourse.operators" not in (Path(text.__file__).parent / name).read_text()


def test_labels_and_values(spark):
    r = parsed(spark, [
        "GATE CLOSES 10:20 GATE B2", "ARRIVAL TIME 10:20 DEPARTURE TIME 08:00", "Your flight at 10:30", "TERMINAL BUILDING 2",
        "BOARDING TIME 8:05 PM", "FLIGHT NO. BER167", "Departure 10:20", "BOARDING 12:10 am DEPARTS 12.40 p.m.",
        "FLIGHT TERMINAL GATE SEAT BOARDING\nBA 1234 2 14 21C 09:40\nDEPARTURE 10:15", "GATE TBA TERMINAL 2", "GATE information is on screens 4",
        "Flight number: XY12 Gate no. G7 Seat 7 Boarding group 3 Boarding 9h05", "TERMINAL NORTH GATE A", "BOARDING PASS 12 GATE 5",
        "CHECK-IN CLOSES 08:00 STD 2024-05-01 09:10", "BOARDING\n07:15", None,
    ])
    got = [(x.flight_number, x.gate, x.terminal_value if x.terminal_source == "printed" else None, x.boarding_time, x.departure_time) for x in r]
    none = (None,) * 5
    assert got == [
        (None, "B2", None, None, None), (None, None, None, None, "08:00"), (None, None, None, None, "10:30"), (None, None, "2", None, None),
        (None, None, None, "20:05", None), ("BER167", None, None, None, None), (None, None, None, None, "10:20"),
        (None, None, None, "00:10", "12:40"), ("BA 1234", "14", "2", "09:40", "10:15"), (None, None, "2", None, None), none,
        ("XY12", "7", None, "9:05", None), (None, "A", "NORTH", None, None), (None, "5", None, None, None),
        (None, None, None, None, "2024-05-01 09:10"), (None, None, None, "07:15", None), none]


def test_route_does_not_depend_on_the_number_of_cities(spark):
    names = spark.range(60_000).selectExpr("id AS city_key", "concat('TOWN ', id, CASE WHEN id % 7 = 0 THEN ' UPON SEA' ELSE '' END) AS city")
    df = spark.createDataFrame([(1, "FLIGHT BA1 TOWN 14 UPON SEA → TOWN 59999 GATE B1"), (2, "TOWN 14 TOWN 8 GATE B1"), (3, "")], "pass_id long, text string")
    r = {x.pass_id: x for x in pt.extract_route(df, names).collect()}
    assert (r[1].dep_city, r[1].dest_city, r[1].route_source) == ("TOWN 14 UPON SEA", "TOWN 59999", "marked")
    assert r[2].route_source is None and r[3].route_source is None      # TOWN 14 is no city of its own
    none = pt.extract_route(df, names.limit(0)).collect()
    assert len(none) == 3 and all(x.dep_city is None for x in none)
