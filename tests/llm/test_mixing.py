import numpy as np
import pytest

from concourse.llm import mixing as m


def brute_targets(sizes):
    """Water filling by sorting, on {source: size}."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * sizes[s] < weight[s] * level]
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{i % 4}") for i in range(900)]
    rows += [(1000 + i, "a b c", "hot") for i in range(400)] + [(2000, "w " * 5000, "s1")]
    return rows + [(3000, None, "s0"), (3001, "", "s2"), (3002, "one", None), (None, "x y", None),
                   (3003, "a b\tc\x0bd", "tiny"), (3004, "x", "é"), (3004, "x", "é"), (3005, None, "empty")]


def test_targets_and_taken(make_docs, docs, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 64)  # several blocks and levels
    plan = m.mix_plan(make_docs(docs)).collect()
    assert len(plan) == len(docs)
    sizes, taken, largest = {}, {}, {}
    for r in plan:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert 0 <= r.copies <= 3
    want = brute_targets(sizes)
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert abs(taken["s0"] - want["s0"]) < 0.02 * want["s0"]
    assert {r.size for r in plan if r.doc_id == 3003} == {3}  # other blanks than ASCII part no words


def test_reruns_agree_on_any_partitioning(make_docs, docs):
    assert rows_of(m.mix_plan(make_docs(docs, 2))) == rows_of(m.mix_plan(make_docs(docs, 7)))


def test_expected_copies_are_kept():
    size = np.sort(np.random.default_rng(0).integers(1, 500, 40))[::-1].astype(float)
    total = np.zeros(40)
    for i in range(4000):
        p, left = m._meet_pool(size, 0.3, np.random.default_rng(i).random(40))
        assert p @ size == pytest.approx(0.3 * size.sum())
        assert all(x in (0.0, 1.0) for j, x in enumerate(p) if j != left)
        total += p
    assert np.abs(total / 4000 - 0.3).max() < 0.04
    p, left = m._meet(size, np.linspace(0.1, 0.9, 40), np.random.default_rng(1).random(40))
    assert p @ size == pytest.approx(np.linspace(0.1, 0.9, 40) @ size)


def test_mix_rows(make_docs, docs):
    df = make_docs(docs)
    out = m.mix_sources(df)
    assert out.columns == df.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    plan = {}
    for r in m.mix_plan(df).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + (r.copies if r.size else 1)
    assert times == {k: v for k, v in plan.items() if v}


def test_empty(make_docs):
    assert m.mix_plan(make_docs([])).count() == 0 and m.mix_sources(make_docs([])).count() == 0
