"""Nesting, loading, publishing and the session's shared folder."""

import json

import pytest
from helpers import MONDAY, lounge_row, lounges, pass_row, passes

from concourse import session
from concourse.operators.nesting import nest_by_page
from concourse.sources import catalog_io as io
from concourse.streaming import micro_batch as mb


def test_pages_without_codes_keep_their_own_lounges_in_order(spark):
    items = spark.createDataFrame([("u1", 3, "c"), ("u1", 1, "a"), ("u1", 2, "b"), ("u2", 1, "z")], "url string, pos int, lounge_id string")
    pages = spark.createDataFrame([("u1", "N/A"), ("u2", "N/A"), ("u3", "N/A")], "url string, airport_code string")
    r = {x.url: [y.lounge_id for y in x.lounges] for x in nest_by_page(items, pages, ["lounge_id"]).collect()}
    assert r == {"u1": ["a", "b", "c"], "u2": ["z"], "u3": []}


def test_load_switches_whole_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert io.load_catalog_overwrite(spark, a, "switch_test") == 2
    assert io.load_catalog_overwrite(spark, a.filter("k = 1"), "switch_test") == 1
    bad = a.selectExpr("k", "raise_error('broken') AS v")
    with pytest.raises(Exception):
        io.load_catalog_overwrite(spark, bad, "switch_test")
    assert spark.table("concourse.switch_test").count() == 1   # the failed load left the table alone
    old = spark.table("concourse.switch_test")
    assert io.load_catalog_overwrite(spark, a.selectExpr("k", "k * 2 AS w"), "switch_test") == 2
    assert old.collect() == [(1, "x")] and spark.table("concourse.switch_test").columns == ["k", "w"]   # a reader sees old or new
    for _ in range(4):
        io.load_catalog_overwrite(spark, a, "switch_test")
    assert len(session.folders(spark, f"{session.shared_dir(spark)}/concourse.db/switch_test-loads")) == io.KEPT_LOADS


def test_release_leaves_loads(spark):
    df = spark.range(5)
    with session.scratch_scope(spark):
        io.load_catalog_overwrite(spark, df, "kept_test")
    assert spark.table("concourse.kept_test").count() == 5
    session.release(spark)
    assert spark.table("concourse.kept_test").count() == 5


def test_arrays_are_written_in_pieces_and_read_in_splits(spark):
    rows = spark.range(3000).selectExpr("id", "concat('A', id % 7) AS airport_code", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'é \\n  { [x], ' END AS name",
                                        "array(named_struct('lounge_id', concat('L', id))) AS lounges")
    base = session.scratch_path(spark, "array-test")
    io.write_json_arrays(rows.coalesce(1), f"{base}/own")
    files = [r.path for r in spark.read.format("binaryFile").load(f"{base}/own/part-*").select("path").collect()]
    assert len(files) == 1
    text = "\n".join(r.value for r in spark.read.text(files[0], wholetext=True).collect())
    records = json.loads(text)
    assert len(records) == 3000 and records[0]["name"] is None
    spark.createDataFrame([(json.dumps(records, indent=2, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{base}/crawler")
    spark.createDataFrame([(json.dumps(records),)], "value string").coalesce(1).write.text(f"{base}/one-line")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for path in ("own", "crawler"):
            got = io.scan_catalog_json(spark, f"{base}/{path}", rows.schema)
            assert got.rdd.getNumPartitions() > 3
            assert sorted(got.collect(), key=lambda r: r.id) == rows.collect()
        assert io.infer_schema(spark, f"{base}/own").simpleString() == \
            "struct<airport_code:string,id:bigint,lounges:array<struct<lounge_id:string>>,name:string>"
        assert io.scan_catalog_json(spark, f"{base}/crawler", None).count() == 3000
        assert io.scan_catalog_json(spark, f"{base}/one-line", rows.schema, pretty=False).count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    io.write_json_arrays(rows.limit(0), f"{base}/none")
    assert io.scan_catalog_json(spark, f"{base}/none", rows.schema).count() == 0


def test_one_winner_per_page_and_bounded_reads(spark, monkeypatch):
    base = session.scratch_path(spark, "test-merge")
    monkeypatch.setattr(mb, "COMPACT_EVERY", 3)
    make = lambda rows: spark.createDataFrame(rows, "url string, crawled int, v string").coalesce(1)
    args = f"{base}/src", f"{base}/out", f"{base}/ck"
    want = {}
    for i in range(11):
        rows = [("u1", i, f"new{i}"), ("u1", i - 1, f"old{i}"), (f"p{i}", i, "x"), ("late", 20 - i, f"l{i}")]
        for u, c, v in rows:
            if c >= want.get(u, (-9, ""))[0]:
                want[u] = (c, v)
        r = mb.incremental_publish(spark, make(rows), *args, crawled="crawled")
        assert {x.url: (x.crawled, x.v) for x in r.collect()} == want
    there = session.folders(spark, args[1])
    assert len(there) <= 2 * 3 + 3 and r.count() == 13


def test_parsed_annotations(spark):
    schema = ("pass_id long, full_text string, pages array<struct<langs:array<string>,blocks:array<struct<paragraphs:"
              "array<struct<words:array<struct<confidence:double>>>>>>>>")
    page = lambda c: [(["en"], [([([(c,), (c,)],)],)])]
    df = spark.createDataFrame([(1, "PARIS → OSLO GATE B2", page(0.9)), (2, "PARIS → OSLO", page(0.5)), (3, "nothing", page(0.9)),
                                (4, None, page(0.9)), (5, "x", [])], schema)
    cities = spark.createDataFrame([(0, "PARIS"), (1, "OSLO")], "city_key long, city string")
    batch = sorted(mb.parsed_annotations(df, cities).collect(), key=lambda r: r.pass_id)
    assert [(r.status, r.dep_city, r.gate) for r in batch] == [
        ("accepted", "PARIS", "B2"), ("low_confidence", None, None), ("rejected", None, None), ("rejected", None, None), ("low_confidence", None, None)]
    base = session.scratch_path(spark, "test-ocr")
    got = mb.parse_ocr_stream(spark, df, cities, f"{base}/src", f"{base}/out", f"{base}/ck", n_files=2)
    assert sorted(map(str, (r.asDict() for r in got.select(*sorted(got.columns)).collect()))) == \
        sorted(map(str, ({k: r[k] for k in sorted(got.columns)} for r in batch)))


def test_published_pages_are_replaced(spark):
    base = session.scratch_path(spark, "test-publish")
    one = spark.createDataFrame([("u1", 1), ("u2", 1)], "url string, n int")
    mb.incremental_publish(spark, one, f"{base}/src", f"{base}/out", f"{base}/ck")
    again = spark.createDataFrame([("u1", 2)], "url string, n int")
    r = mb.incremental_publish(spark, again, f"{base}/src", f"{base}/out", f"{base}/ck")
    assert sorted(map(tuple, r.select("url", "n").collect())) == [("u1", 2), ("u2", 1)]


def test_catalog_is_read_for_each_micro_batch(spark):
    base, seen = session.scratch_path(spark, "test-catalog"), []
    now = MONDAY.replace(hour=9)

    def catalog():
        seen.append(len(seen))
        return lounges(spark, [lounge_row(f"L{len(seen)}", "Open 24 hours")])

    p = passes(spark, [pass_row(i, now, boarding="10:00") for i in range(8)])
    r = mb.recommend_stream(spark, p, catalog, f"{base}/src", f"{base}/out", f"{base}/ck", n_files=2)
    assert len(seen) == 2 and {x.lounge_id for x in r.collect()} == {"L1", "L2"}


def test_scratch_is_removed(spark):
    df = spark.range(5)
    with session.scratch_scope(spark):
        path = session.scratch_path(spark, "gone")
        df.write.parquet(path)
        assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
