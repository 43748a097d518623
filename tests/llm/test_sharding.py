import zlib

import numpy as np
from pyspark.sql import functions as F

from concourse.llm import sharding as sh


def checked(rows, docs, shards):
    got = sh.assign_shards(docs, shards).collect()
    assert len(got) == len(rows)
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_sizes_near_equal_with_a_hot_group(make_docs, monkeypatch):
    monkeypatch.setattr(sh, "RANGE_ROWS", 50)
    monkeypatch.setattr(sh, "SAMPLES", 4)
    rng = np.random.default_rng(1)
    rows = [(i, "é" * int(rng.integers(0, 300))) for i in range(1500)] + [(5000 + i, "copy " * 30) for i in range(900)]
    rows += [(None, None), (7, None), (8, ""), (8, "")]
    got = checked(rows, make_docs(rows), 10)
    size = np.zeros(10)
    for r in got:
        size[r["shard"]] += r["size"]
    assert np.abs(size - size.mean()).max() <= 616
    again = sh.assign_shards(make_docs(rows, 5), 10)
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(str, again.select(key).collect())) == sorted(str(r) for r in sh.assign_shards(make_docs(rows), 10).select(key).collect())


def test_copies_lie_together(make_docs):
    rows = [(i, f"text {i // 3} " * 5) for i in range(300)]
    by = {}
    for r in checked(rows, make_docs(rows), 8):
        by.setdefault(r["a"], []).append((r["shard"], r["slot"]))
    together = sum(max(s for _, s in v) - min(s for _, s in v) == 2 for v in by.values() if len({x for x, _ in v}) == 1)
    assert together >= len(by) - 8


def test_splitters_order():
    cuts = [(1, 5), (1, 9), (4, 0), (4, 0)]
    s, keys = sh.Splitters(cuts), [(0, 0), (1, 4), (1, 5), (1, 8), (1, 9), (2, 0), (4, -1), (4, 0), (9, 9)]
    a, b = (np.array(x) for x in zip(*keys))
    want = [sum(tuple(k) >= c for c in sorted(set(cuts))) for k in keys]
    assert s.range_of(a, b).tolist() == want


def test_few_rows_and_written_shards(make_docs, spark, tmp_path):
    checked([(1, "a")], make_docs([(1, "a")]), 40)
    assert sh.assign_shards(make_docs([]), 40).count() == 0
    rows = [(i, f"t{i}") for i in range(50)] + [(1, "t1")]
    docs = make_docs(rows, extra=False)
    sh.write_shards(docs, 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(rows)
    assert back.select("shard", "slot").distinct().count() == 51


def test_clashing_columns_and_bounded_ranges(make_docs, spark, tmp_path, monkeypatch):
    rows = [(i, f"t{i}" * (i % 9)) for i in range(60)]
    docs = make_docs(rows).withColumn("_a", F.lit("own")).withColumn("slot", F.lit("own"))
    sh.write_shards(docs, 4, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(rows)
    assert {(r["shard"], r["slot"], r["_a"]) for r in back.select("shard", "slot", "_a").collect()} == {("x", "own", "own")}
    assert back.select("_shard", "_slot").distinct().count() == 60
    monkeypatch.setattr(sh, "RANGE_ROWS", 5)
    monkeypatch.setattr(sh, "MOST_RANGES", 3)
    monkeypatch.setattr(sh, "LEAST_RANGES", 2)
    checked(rows, make_docs(rows), 7)
