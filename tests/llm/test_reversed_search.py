import math
import random
import re
from collections import Counter

import pytest

from concourse.llm import reversed_search as rs

ITEM_SCHEMA = "item_id long, text string, doc_id string, score string, key string"


def words_of(text):
    upper = {c: c + 32 for c in range(65, 91)}
    return re.findall(rs.TERMS, text.translate(upper)) if text else []


def brute(docs, items, k=10):
    """Every document against every item."""
    bags = [(i, words_of(t)) for i, t in docs]
    bags = [(i, w, Counter(w)) for i, w in bags if w]
    n_docs, total = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for _, w, c in bags for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, w, c in bags:
            m, s = 25 + 75 * len(w) * n_docs // total, 0
            for t in words_of(text):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def make_items(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], ITEM_SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["the", "of", "and"] * 40 + [f"w{i}" for i in range(150)] + ["Straße", "ÉTÉ", "日本", "x-ray", "A1"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 120)))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)] + [(7, "the w1"), (None, docs[5][1]), (None, "w3 w4"), (2000, None), (2001, ""), (2002, "!?"),
             (2003, "w5 " * 30_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(40)]
    items += [(3, items[3][1]), (90, None), (91, ""), (92, "unknown here"), (None, "w7 THE w7"), (94, "the of and the")]
    return docs, items


@pytest.mark.parametrize("size, most, cells", [(1024, 20_000, 1 << 21), (64, 9, 300)])
def test_equals_brute_force(spark, make_docs, corpus, monkeypatch, size, most, cells):
    docs, items = corpus
    monkeypatch.setattr(rs, "MOST_ITEMS", most)      # several blocks of items
    for name, value in (("SLICE", size), ("CELLS", cells)):
        monkeypatch.setattr(rs, name, value)
    got = sorted((tuple(r) for r in rs.ranked(make_docs(docs), make_items(spark, items)).collect()), key=str)
    assert got == brute(docs, items)


def test_scorer_skips_and_stays_exact(corpus):
    """Small slices fill the heaps early, so that later ones leave frequent terms out."""
    docs, items = corpus
    own = [(str(i).encode(), rs.terms(t)) for i, t in items[:40]]
    index = rs.ItemIndex.of(own)
    bags = [(i, rs.terms(t)) for i, t in docs if i is not None and rs.terms(t)]
    df = Counter(t for _, w in bags for t in set(w))
    weighed = index.weighed(len(bags), rs.np.array([df[t] for t in index.vocabulary]))
    scorer, left_out = rs._Scorer(weighed, len(bags), sum(len(w) for _, w in bags), 3), 0
    part = scorer._part
    def seen(at, n, row, term, gain, low, *more):
        nonlocal left_out
        left_out += int(low.sum())
        part(at, n, row, term, gain, low, *more)
    scorer._part = seen
    for at in range(0, len(bags), 16):
        some = bags[at:at + 16]
        scorer.add(rs.np.array([i for i, _ in some]), rs.np.zeros(len(some), bool),
                   [(len(w), {index.vocabulary[t]: n for t, n in Counter(w).items() if t in index.vocabulary}) for _, w in some])
    got = sorted((int(own[i][0]), int(d), int(s)) for i, s, d, _ in zip(*scorer.heap))
    assert left_out > 0
    assert got == sorted((i, d, s) for i, _, d, s in brute([d for d in docs if d[0] is not None], items[:40], 3))


def test_empty_tables(spark, make_docs):
    some = make_items(spark, [(1, "a b")])
    assert rs.ranked(make_docs([]), some).count() == 0
    assert rs.ranked(make_docs([(1, None)]), some).count() == 0
    assert rs.ranked(make_docs([(1, "a")]), make_items(spark, [])).count() == 0
