import random
import zlib

import numpy as np
import pytest

from concourse.llm import toxicity as tox
from concourse.llm.common import table


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    rng = random.Random(8)
    plain = [f"p{i}" for i in range(300)]
    bad = ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=rng.randint(3, 60))
        y = int(i % 5 == 0)
        if y:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + "!")
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    rows += [(1000, None), (1001, ""), (1002, "p1 " * 20_000 + "vile nasty"), (1002, "p1 p2"), (None, "vile nasty rotten"), (1003, "...")]
    labels += [(5000, 1), (7, None), (None, 1), (0, 0)]
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_index_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(700):
        t = rng.choice(30, rng.integers(1, 6), replace=False)
        w = rng.random(len(t)) + 0.1
        vectors.append(dict(zip(t.tolist(), (w / np.linalg.norm(w)).tolist())))
    vectors += [vectors[3]] * 90
    ids = rng.permutation(len(vectors))
    post = {}
    for i, v in enumerate(vectors):
        for t, w in v.items():
            post.setdefault(t, ([], []))
            post[t][0].append(i)
            post[t][1].append(w)
    index = tox.BlockMaxIndex(ids, np.zeros(len(ids)), {t: (np.array(a), np.array(w)) for t, (a, w) in post.items()})
    for q in [*vectors[:60], {99: 1.0}]:
        rows, cos = index.nearest(q, 16)
        exact = np.array([sum(w * v.get(t, 0) for t, w in q.items()) for v in vectors])
        want = [i for i in np.lexsort((ids, -np.round(exact, 12))) if exact[i] > 0][:16]
        assert ids[rows].tolist() == ids[want].tolist() and cos == pytest.approx(exact[want])


def test_blocks_are_skipped_and_search_stays_exact():
    """Batches of queries, terms that half of the examples hold, examples of two kinds in blocks of their own."""
    rng = np.random.default_rng(4)
    n, terms = 3000, 900
    vectors = np.zeros((n, terms))
    for i in range(n):
        half = 450 * (i >= n // 2)
        vectors[i, half + rng.choice(5, 4, replace=False)] = rng.random(4) * 0.1       # frequent ones
        vectors[i, half + 5 + rng.choice(445, 25, replace=False)] = rng.random(25) + 0.2
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    row, term = np.nonzero(vectors)
    ids = rng.permutation(n)
    index = tox.BlockMaxIndex.of(ids, np.zeros(n), term, row, vectors[row, term])
    assert index.frequent.sum() == 10
    queries = []
    for i in range(64):
        t = rng.choice(450, 30, replace=False)
        t = np.union1d(t, np.arange(5)) if i % 2 else t
        w = rng.random(len(t))
        queries.append((t, w / np.linalg.norm(w)))
    queries.append((np.array([0, 5000]), np.array([0.5, 0.5])))
    for (rows, cos), (t, w) in zip(index.search_all(queries, 16), queries):
        q = np.zeros(6000)
        q[t] = w
        exact = vectors @ q[:terms]
        want = [i for i in np.lexsort((ids, -np.round(exact, 12))) if exact[i] > 0][:16]
        assert rows.tolist() == want and cos == pytest.approx(exact[want])
    assert index.opened <= 0.55 * index.blocks


def test_scores_equal_brute_force(labelled):
    """Weights, votes, choice of the mark's weight, calibration and final scores, in plain Python."""
    import math
    from collections import Counter
    docs, labels, rows = labelled
    got = {(r.doc_id, r.score): list(r.evidence) for r in tox.toxicity_scores(docs, labels).collect()}
    examples = [r.asDict() for r in tox.labelled_texts(docs, labels).collect()]
    marks = {t for t, m in zip(*(tox.example_terms(tox.labelled_texts(docs, labels).filter("part > 0"))[c] for c in ("term", "marks"))) if m}
    bags = lambda t: Counter(tox.WORD.findall((t or "").lower()))
    hashed = lambda w: int(tox.hashes([w])[0])
    texts = [t for _, t in rows]
    df = Counter(w for t in texts for w in bags(t))
    known = {w for e in examples if e["part"] for w in bags(e["text"])}

    def vector(text, mark):
        v = {w: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) * (mark if hashed(w) in marks else 1)
             for w, n in bags(text).items() if w in known}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    def vote(v, own):
        near = [(round(sum(x * o.get(w, 0) for w, x in v.items()), 12), -e["id"], e) for e, o in own]
        near = sorted([x for x in near if x[0] > 0], key=lambda x: x[:2], reverse=True)[:16]
        weights = [1 / (1.05 - min(c, 1)) for c, _, _ in near]
        return (sum(w * e["label"] for w, (_, _, e) in zip(weights, near)) / sum(weights) if near else -1), [e["id"] for _, _, e in near]

    best = None
    for mark in tox.MARKS:
        own = [(e, vector(e["text"], mark)) for e in examples if e["part"] and bags(e["text"])]
        raws = [(vote(vector(e["text"], mark), own)[0], e["label"]) for e in examples if not e["part"]]
        raws = [r for r in raws if r[0] >= 0]
        up, down = [r for r, y in raws if y >= 0.5], [r for r, y in raws if y < 0.5]
        area = sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))
        if best is None or area >= best[0] - 1e-9:
            best = (max(area, best[0] if best else 0), mark, own, raws)
    _, mark, own, raws = best
    steps, last = [], 0.0
    for i in range(tox.BINS):
        inside = [y for r, y in raws if min(int(r * tox.BINS), tox.BINS - 1) == i]
        last = max(last, (sum(inside) + 2 * (i + 0.5) / tox.BINS) / (len(inside) + 2))
        steps.append(last)
    for i, text in rows[:60] + rows[-6:]:
        raw, evidence = vote(vector(text, mark), own)
        score = float(np.interp(raw * tox.BINS, np.arange(tox.BINS) + 0.5, steps)) if raw >= 0 else None
        found = [s for d, s in got if d == i]
        assert score is None or any(s == pytest.approx(score, abs=1e-9) for s in found), (i, score, found)
        assert score is None or any(got[i, s] == evidence for s in found)


def test_sample_is_bounded_in_bytes(labelled, monkeypatch):
    docs, labels, _ = labelled
    monkeypatch.setattr(tox, "MAX_BYTES", 5_000)
    got = tox.labelled_texts(docs, labels).collect()
    assert 3_000 < sum(len(r.text.encode()) for r in got) <= 5_000


def test_scores(labelled):
    docs, labels, rows = labelled
    out = tox.toxicity_scores(docs, labels).collect()
    assert len(out) == len(rows)
    score = {(r.doc_id, r.evidence is not None and len(r.evidence) > 0): r for r in out}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    wrong = sum(r.predicted != (r.doc_id % 5 == 0) for r in out if r.doc_id is not None and r.doc_id < 400)
    assert wrong <= 4
    assert score[1002, True].predicted == 1 and score[None, True].predicted == 1
    assert all(score[i, False].predicted == 0 for i in (1000, 1001, 1003))
    assert all(e % 5 == 0 for r in out if r.predicted for e in r.evidence if e < 400)


def test_texts_without_marked_terms_have_neighbours(spark, make_docs):
    """Vectors hold all terms: a text without any term that marks the label finds the labelled text of the same words."""
    rng = random.Random(3)
    words = {i: [f"own{i}x{j}" for j in range(10)] + rng.choices([f"p{j}" for j in range(50)], k=10) for i in range(120)}
    rows = [(i, " ".join(w)) for i, w in words.items()]
    rows += [(1000 + i, " ".join(reversed(w))) for i, w in words.items()]  # not labelled
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in words], "doc_id long, toxic int")
    docs = make_docs(rows)
    examples = {r.id for r in tox.labelled_texts(docs, labels).filter("part > 0").collect()}
    assert not tox.example_terms(tox.labelled_texts(docs, labels).filter("part > 0")).marks.any()
    got = {r.doc_id: r for r in tox.toxicity_scores(docs, labels).collect()}
    assert len(examples) > 30 and all(got[1000 + i].evidence[0] == i for i in examples)
    assert all(len(r.evidence) > 0 for r in got.values())


def test_rejected_rows_go(labelled):
    docs, labels, rows = labelled
    out = tox.reject_toxic(docs, labels)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert None not in kept and {1000, 1001, 1003} <= kept and len([i for i in kept if i < 400 and i % 5 == 0]) <= 4


def test_held_out_labels_are_not_used(labelled, spark):
    docs, labels, _ = labelled
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda df: sorted(str((r.doc_id, r.score)) for r in tox.toxicity_scores(docs, df).collect())
    assert key(labels) == key(flipped)


def test_without_labels_or_documents(labelled, spark, make_docs):
    docs, labels, rows = labelled
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tox.toxicity_scores(docs, none).collect()} == {0.0}
    assert tox.toxicity_scores(make_docs([]), labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    r = tox.toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels")).join(table(spark, d, "labels"), "doc_id")
    p = r.filter("held_out AND toxic IS NOT NULL").select("score", "predicted", "toxic").toPandas()
    ranks, pos = p.score.rank().to_numpy(), p.toxic.to_numpy() == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / pos.sum() / (~pos).sum()
    assert auc >= 0.9 and (p.toxic[p.predicted == 1] == 1).mean() >= 0.9
