import math

import numpy as np
import pytest

from concourse.llm import queries, whitening as wh
from concourse.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, n string, z string, _v string"


def brute(rows):
    """Plain integer sums over all rows."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n ** 3 for j in range(d)] for i in range(d)])
    e, axes = np.linalg.eigh(v)
    dev = [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x]
    centred = np.array([[(n * c - t) / n for c, t in zip(r, s)] for r in x])
    return n, e[::-1], axes[:, ::-1].T, dev, centred, np.trace(v)


def held_against(got, rows, k):
    n, e, axes, dev, centred, total = brute(rows)
    at = {}
    for r in got:
        at.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows) * k and len({r.identity_error for r in got}) == 1
    for c in range(1, k + 1):
        z = np.array([at[i][c].whitened for i, _ in rows])
        want = centred @ axes[c - 1] / math.sqrt(e[c - 1])
        assert min(np.abs(z - want).max(), np.abs(z + want).max()) < 1e-7 * max(1, np.abs(want).max())
    for (i, _), y in zip(rows, dev):
        r = at[i][1]
        assert r.n == n and r.deviation == y and r.explained == pytest.approx(e[0] / total, rel=1e-9) and r.identity_error < 1e-4


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    held_against(queries.QUERIES["op11_whitening"](spark, sf).collect(), rows, 8)


@pytest.mark.parametrize("low, high", [(0, 1), (-1000, 5), (-(1 << 61), 1 << 61), (7, 8)])
def test_cross_products_are_exact(low, high):
    x = np.random.default_rng(1).integers(low, high, (333, 5))
    x[:, 2] = high - 1
    s, p = wh.cross_products(x)
    own = x.astype(object)
    assert [int(v) for v in s] == [int(v) for v in own.sum(axis=0)]
    limbs = np.stack(wh._limbs(p))
    for i in range(5):
        for j in range(i, 5):
            exact = int((own[:, i] * own[:, j]).sum())
            assert int(p[i, j]) == exact and sum(int(limbs[k, i, j]) << 32 * k for k in range(wh.LIMBS)) == exact


def test_nulls_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100, [1e4, -1e4, 0.0, 3.0])]
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [1.0, float("nan"), 0.0, 0.0]),
           (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", "y", "w") for i, v in good + odd], SCHEMA).repartition(3)
    held_against(wh.whitened(df).collect(), good, 4)
    twice = spark.createDataFrame([(None if i == 3 else 5, v, "x", "y", "w") for i, v in good], SCHEMA)
    assert wh.whitened(twice, 2).count() == 2 * len(good)


def test_without_variance(spark):
    make = lambda rows: spark.createDataFrame([(i, v, "", "", "") for i, v in rows], SCHEMA)
    assert wh.whitened(make([])).count() == 0
    assert wh.whitened(make([(1, [0.5, 0.25])])).count() == 0
    assert wh.whitened(make([(i, [0.5, 0.25]) for i in range(9)])).count() == 0
    line = wh.whitened(make([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()
    assert len(line) == 9 and all(r.component == 1 and r.explained == pytest.approx(1) for r in line)


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float((-1) ** i) * 1e7, 1.0]) for i in range(50)]
    out = wh.whitened(spark.createDataFrame([(i, v, "", "", "") for i, v in rows], SCHEMA)).collect()
    assert len(out) == 50 and all(r.deviation is None for r in out) and all(abs(abs(r.whitened) - 1) < 1e-9 for r in out)
