"""Small hand-built passes and lounges for golden tests."""

import datetime as dt

SF_SMALL = "/root/testdata/sf0.001"

PASS_SCHEMA = ("pass_id long, user_id long, now_ts timestamp_ntz, airport_code string, boarding string, "
               "departure string, terminal string, terminal_source string, terminal_confidence double, "
               "gate string, flight_number string, dest_iata string")
LOUNGE_SCHEMA = ("lounge_id string, name string, airport_code string, terminal string, opening_hours string, "
                 "amenities string, access_notes string, conditions array<string>, image_url string, "
                 "detail_url string")

MONDAY = dt.datetime(2024, 1, 1)  # a Monday


def pass_row(pid, now, boarding=None, departure=None, terminal=None, gate=None, airport="A01", dest=None):
    return (pid, pid, now, airport, boarding, departure, terminal, "printed" if terminal else None,
            1.0 if terminal else 0.0, gate, f"XY{pid}", dest)


def lounge_row(lid, hours, terminal="1", airport="A01"):
    return (lid, f"Lounge {lid}", airport, terminal, hours, "Wi-Fi", "N/A", [], "", f"https://x/{lid}")


def passes(spark, rows):
    return spark.createDataFrame(rows, PASS_SCHEMA)


def lounges(spark, rows):
    return spark.createDataFrame(rows, LOUNGE_SCHEMA)
