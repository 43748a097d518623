import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from concourse.llm import order_minhash as om
from concourse.llm.common import WORD


def words(n, rng):
    return [f"w{rng.randint(0, 4000)}" for _ in range(n)]


def edited(ws, edits, rng):
    ws = list(ws)
    for _ in range(edits):
        i = rng.randrange(len(ws))
        ws[i:i + 1] = rng.choice([["new" + str(rng.random())], [], [ws[i], "more" + str(rng.random())]])
    return ws


def lcs(a, b):
    """Longest common subsequence by the bit-parallel recurrence: a zero bit per step of the row."""
    full = (1 << len(a)) - 1
    at = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def brute_classes(rows):
    """Classes by aligning all pairs of texts whose lengths and word counts allow a share of 0.8."""
    texts = [(i, tuple(WORD.findall(t.lower())), t) for i, t in rows if t is not None]
    bags = [Counter(w) for _, w, _ in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            a, b = texts[x][1], texts[y][1]
            same = a == b if a or b else texts[x][2] == texts[y][2]
            need = 0.8 * max(len(a), len(b))
            if not same and a and b and min(len(a), len(b)) >= need and (bags[x] & bags[y]).total() >= need:
                same = lcs(a, b) >= need
            if same:
                up[max(find(x), find(y))] = min(find(x), find(y))
    out = {}
    for x, (i, _, _) in enumerate(texts):
        out.setdefault(find(x), []).append(i)
    return {frozenset(v) for v in out.values()}


def classes(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.class_id, set()).add(r.doc_id)
    return {frozenset(v) for v in out.values()}


@pytest.fixture(scope="module")
def rows():
    rng, rows, i = random.Random(4), [], 0
    passage = words(60, rng)
    for _ in range(12):
        base = words(rng.randint(30, 200), rng)
        rows.append((i, " ".join(base)))
        for k in range(rng.randint(0, 4)):
            i += 1
            rows.append((i, " ".join(edited(base, max(1, len(base) // 40), rng)).upper() if k % 2 else " ".join(base) + "!"))
        i += 1
    rows += [(500 + k, " ".join(words(90, rng) + passage + words(60, rng))) for k in range(25)]  # share a passage only
    base = words(120, rng)
    rows += [(700 + k, " ".join(edited(base, 3, rng))) for k in range(40)]                       # one large group
    shuffled = base[60:] + base[:60]
    rows += [(800, " ".join(shuffled)), (900, "a b"), (901, "A  b."), (902, "a c"), (903, ""), (904, ""), (905, "!!!"),
             (906, "echo " * 3000), (907, "echo " * 2900)]
    return rows


def test_classes_equal_all_pairs(make_docs, rows, monkeypatch):
    monkeypatch.setattr(om, "MORE", 2)  # more rounds
    got = om.near_duplicate_classes(make_docs(rows))
    assert classes(got) == brute_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.collect())


def test_alignment_equals_dynamic_programming():
    rng = random.Random(0)
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(1, 40))]
        b = edited([*a, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7], rng.randint(0, 10), rng)
        assert lcs(a, b) == plain_lcs(a, b)
        share = lcs(a, b) / max(len(a), len(b))
        assert om.aligned_share(a, b) == pytest.approx(share if share >= 0.8 - 1e-12 else 0.0)


@pytest.mark.parametrize("length", [60, 300])
@pytest.mark.parametrize("share", [0.8, 0.85, 0.9, 0.95])
def test_recall_at_the_law(length, share):
    """Of pairs whose alignment keeps just this share, at least nine in ten meet in a bucket, whichever way the words go."""
    rng, met, n = random.Random(length), 0, 150
    for i in range(n):
        a = words(length, rng)
        gone = set(rng.sample(range(length), round(length * (1 - share))))
        if i % 3 < 2:
            b = [f"new{i}x{j}" if j in gone else w for j, w in enumerate(a)]     # replaced
        else:
            b = [w for j, w in enumerate(a) if j not in gone]                    # left out
        assert om.aligned_share(om.word_hashes(a).tolist(), om.word_hashes(b).tolist()) > 0
        keys = om._buckets(om.word_hashes(a + b), np.array([len(a), len(b)]))
        met += len(set(keys[0].tolist()) & set(keys[1].tolist())) > 0
    assert met >= 0.9 * n


def test_bins_never_drop_a_link(spark):
    rng, rows, want = random.Random(6), [], []
    for i in range(300):
        a = words(rng.randint(5, 400), rng)
        b = edited(a, rng.randint(0, len(a) // 3 + 1), rng) if i % 2 else words(len(a), rng)
        rows.append((i, a, b))
        want.append(om.aligned_share(om.word_hashes(a).tolist(), om.word_hashes(b).tolist()) > 0)
    counted = [(i, *(om.word_bins(om.word_hashes(x), np.array([len(x)]))[0].tolist() for x in (a, b)), len(a), len(b)) for i, a, b in rows if b]
    df = spark.createDataFrame(counted, "i int, x array<long>, y array<long>, n int, m int")
    kept = {r.i for r in df.filter(om._may_align(F.col("x"), F.col("y"), F.col("n"), F.col("m"))).collect()}
    assert {i for i, ok in enumerate(want) if ok} <= kept and len(kept) < 0.75 * len(rows)
    many = om.word_bins(np.zeros(70_000, np.uint64), np.array([70_000]))[0]
    assert many[-1] == 70_000 - om.LEVELS and np.bitwise_count(many[:-1]).sum() == om.LEVELS


def test_sketches_keep_text_order():
    a = om.word_hashes([f"x{i}" for i in range(300)])
    b = np.concatenate([a[150:], a[:150]])
    keys = []
    for h in (a, a.copy(), b):
        mers, counts = om.kmers(h, np.array([len(h)]))
        keys.append(om.sketch_keys(mers, counts)[0])
    assert (keys[0] == keys[1]).all() and (keys[0] == keys[2]).mean() < 0.5


def test_occurrences_are_labelled():
    h = om.word_hashes(["a"] * 40)
    mers, counts = om.kmers(h, np.array([40]))
    assert counts[0] == 36 and len(set(mers.tolist())) == 36


def test_nulls_repeats_and_ids(make_docs):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (7, text + " eight"), (8, None), (9, None), (None, None), (5, "quite another text of words"),
            (11, "a " * 3), (12, "b b")]
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in om.near_duplicate_classes(make_docs(rows)).collect()), key=str)
    want = [(None, 5, False), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (9, 9, True), (None, None, True),
            (5, 5, True), (11, 11, True), (12, 12, True)]
    assert got == sorted(want, key=str)
    assert om.near_duplicate_classes(make_docs([])).count() == 0


def test_dropped_rows(make_docs, rows):
    docs = make_docs(rows)
    out = om.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {min(c) for c in brute_classes(rows)}
    both = make_docs([(1, None), (1, None), (2, "x y z"), (2, "x y z"), (3, "x y z"), (None, "only here a b c"), (None, "only here a b c")])
    kept = [(r.doc_id, r.text) for r in om.drop_near_duplicates(both).collect()]
    assert kept.count((2, "x y z")) == 1 and kept.count((3, "x y z")) == 0 and kept.count((1, None)) == 2
    assert kept.count((None, "only here a b c")) == 1


def test_cells_lose_no_link(make_docs, rows, monkeypatch):
    monkeypatch.setattr(om, "SMALL", 1)      # every bucket is dealt by rare words
    monkeypatch.setattr(om, "SEEN", 2)
    monkeypatch.setattr(om, "MORE", 2)
    assert classes(om.near_duplicate_classes(make_docs(rows))) == brute_classes(rows)


def test_common_passage_makes_few_pairs(spark, make_docs, monkeypatch):
    """Texts that share a passage and little else meet in its buckets, but are not paired there."""
    monkeypatch.setattr(om, "SMALL", 4)
    rng, n = random.Random(9), 200
    passage = words(40, rng)
    own = [[f"x{rng.randint(0, 100_000)}" for _ in range(60)] for _ in range(n)]
    rows = [(i, " ".join(w[:30] + passage + w[30:])) for i, w in enumerate(own)]
    rows += [(n, rows[0][1] + " end"), (n + 1, rows[1][1] + " end")]
    docs = make_docs(rows)
    keys = om.document_keys(docs).cache()
    members = om.bucket_members(keys).cache()
    none = spark.createDataFrame([], "node binary, root binary")
    free = om.open_nodes(members, none)
    assert free.groupBy("bucket").count().agg(F.max("count")).first()[0] > n / 2
    left = om.cells(free, om.candidate_texts(docs, keys, members))
    pairs = om.pivot_pairs(om.ranked_nodes(left, none), None)
    assert pairs.count() < n * n / 2 / 20
    assert {frozenset((0, n)), frozenset((1, n + 1))} <= classes(om.near_duplicate_classes(docs))
