import numpy as np
import pytest
from pyspark.sql import functions as F

from concourse.llm import hnsw


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows],
                                 "vec_id long, embedding array<float>, label int, score string").repartition(3)


def brute(rows, is_query, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in filter(is_query, good):
        s = [(-max(a @ b / np.sqrt((a @ a) * (b @ b)) for a in good[q] for b in vs), i)
             for i, vs in good.items() if i != q and len(vs[0]) == len(good[q][0])]
        out[q] = [(i, -x) for x, i in sorted((round(x, 12), i) for x, i in s)[:k]]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 300)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(30, 16))
    rows = [(i, centre[i % 30] + rng.normal(size=16) * 0.4) for i in range(1500)]
    got, want = {}, brute(rows, lambda i: i % 20 == 0, 5)
    for r in hnsw.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.95
    at = dict(rows)
    for q, near in got.items():
        a = at[q].astype(np.float32).astype(float)
        for i, s in near:
            b = at[i].astype(np.float32).astype(float)
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_cases(spark):
    rows = [(0, [1, 0]), (1, [1, 0]), (2, [2, 0]), (3, [0, 1]), (4, None), (5, []), (6, [0, 0]), (7, [None, 1]), (8, [float("nan"), 1]),
            (9, [float("inf"), 1]), (10, [1, 0, 0]), (11, [-1, 0]), (None, [1, 0]), (12, [1, 1]), (12, [1, 1]), (20, [1, 0, 0]), (30, [5.0])]
    rows += [(100 + i, [1, 0]) for i in range(40)]  # one vector that very many rows share
    got = {}
    for r in hnsw.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 12)))
    assert got[0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 100, 1.0)]
    assert got[10] == [(1, 20, 1.0)] and got[20] == [(1, 10, 1.0)]
    assert 30 not in got and got[100] == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)]
    assert hnsw.nearest(frame(spark, rows[:0]), F.col("vec_id") % 10 == 0, 3).count() == 0
    assert hnsw.nearest(frame(spark, [(10, [1, 2])]), F.col("vec_id") % 10 == 0, 3).count() == 0


def test_graph_survives_storage():
    units = hnsw.unit(np.random.default_rng(1).normal(size=(500, 8)))
    g = hnsw.Graph.build(units, np.random.default_rng(2).random(500))
    h = hnsw.Graph.load(g.dump())
    assert len(g.nodes) > 1 and (g.search(units[3]) == h.search(units[3])).all() and h.search(units[3])[0] == 3
