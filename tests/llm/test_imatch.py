import random

import duckdb
import pytest

from concourse.llm import imatch as im


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}é" for _ in range(4000)]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randint(0, 150)))) for i in range(60)]
    return rows + [(1, None), (4, ""), (7, "ab"), (8, rows[3][1]), (10, "Ünïcode " * 2000), (11, rows[3][1].upper())]


def collected(docs):
    return {r.doc_id: r for r in im.edited_fingerprints(docs).collect()}


def test_matches_sql(make_docs, rows, monkeypatch):
    monkeypatch.setattr(im, "RANGE_ROWS", 7)  # many ranges
    docs = make_docs(rows)
    got = sorted(map(tuple, im.edited_fingerprints(docs).collect()))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = sorted(con.execute(im.edited_sql()).fetchall())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:])


def test_equal_texts_and_cases(make_docs, rows):
    got = collected(make_docs(rows))
    assert got[9].fingerprint == got[8].fingerprint  # the same text
    assert got[1].fingerprint == got[4].fingerprint and got[1].n_chars == 0
    assert got[7].near_edited == 1.0  # under four code points nothing is edited
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_one_document_is_its_own_successor(make_docs):
    r, = im.edited_fingerprints(make_docs([(5, "abcdefgh")])).collect()
    import hashlib
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_null_ids_and_repeated_rows(make_docs):
    rows = [(None, "first text here"), (2, "b c d e"), (2, "b c d e"), (2, "a other")]
    assert im.edited_fingerprints(make_docs(rows)).count() == 4
    assert im.fingerprints(make_docs(rows)).count() == 4
    assert im.edited_fingerprints(make_docs([])).count() == 0


def test_telling_terms_count(make_docs):
    """Terms of 0.1 to 1 % of the documents are in the lexicon, so an edited text that has no others keeps parts."""
    telling = [f"telling{j}" for j in range(40)]
    rows = [(i, " ".join(["the", *(telling if i % 250 == 0 else []), *[f"only{i}x{j}" for j in range(30)]])) for i in range(1000)]
    docs = make_docs(rows)
    assert {r.term for r in im.lexicon(docs).collect()} == set(telling)
    r = next(r for r in im.edited_fingerprints(docs).collect() if r.doc_id == 500)
    assert len(r.fingerprint.split("-")) == 32
    assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0


def test_no_python_in_the_plan(make_docs, rows):
    plan = im.edited_fingerprints(make_docs(rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
