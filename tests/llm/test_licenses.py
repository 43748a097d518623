import duckdb

from concourse.llm import licenses as lic

GRANT, KEEP = lic.SENTENCES[3][1], lic.SENTENCES[4][1]


def test_scan_matches_sql_and_hand(make_docs, spark):
    rows = [
        (1, "Hello.\nThis work is licensed under the GNU General Public License, version 3."),
        (2, f"The MIT License\n{GRANT}:\n{KEEP}."),
        (3, f"{GRANT}. Something else. {KEEP}."),            # not adjacent: the grant alone
        (4, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance "
            "with the License! You may obtain a copy of the License at\n\nx"),
        (5, None), (6, ""), (7, "no licence. Released under the MIT"),
        (8, "Released under the MIT License.\n" * 3), (8, "Released under the MIT License.\n" * 3),
        (None, "word " * 50_000 + "\nLicensed under CC BY-NC 4.0."),
    ]
    docs = make_docs(rows)
    got = sorted(map(tuple, lic.scan_licences(docs).collect()), key=str)
    want = [(1, "gpl-3-notice", "GPL-3.0-only", 1, 1), (2, "mit-full", "MIT", 0, 2), (3, "mit-grant", "MIT", 0, 0),
            (4, "apache-2-header", "Apache-2.0", 0, 2), (None, "cc-by-nc-4", "CC-BY-NC-4.0", 1, 1),
            *[(8, "mit-notice", "MIT", i, i) for i in range(3)]]
    assert got == sorted(want, key=str)
    documents = docs.select("doc_id", "text").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.execute(lic.scan_sql()).fetchall(), key=str) == got


def test_equal_spans_take_the_first_rule_and_long_rules_hold_short_ones(make_docs):
    known = [("a", "x"), ("b", "y"), ("c", "z"), ("a2", "x")]
    rules = [("one", "L", ["a"]), ("pair", "L", ["a", "b"]), ("other", "L", ["a2"]), ("three", "L", ["b", "c", "a"])]
    got = sorted(tuple(r)[1:] for r in lic.scan_licences(make_docs([(1, "X. Y. Z. X. x")]), known, rules).collect())
    assert got == [("one", "L", 4, 4), ("pair", "L", 0, 1), ("three", "L", 1, 3)]


def test_empty(make_docs):
    assert lic.scan_licences(make_docs([])).count() == 0
