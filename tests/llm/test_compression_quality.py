import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from concourse.llm import compression_quality as cq
from concourse.llm.common import table


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    rng = random.Random(8)
    plain = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words, y = rng.choices(plain, k=rng.randint(30, 300)), int(i % 4 > 0)
        rows.append((i, " ".join(words).capitalize() + "." if y else " | ".join(w.upper() + "!!" for w in words)))
        labels.append((i, y))
    rows += [(1000, None), (1001, ""), (1002, rows[4][1] * 40), (1002, rows[5][1]), (None, rows[1][1]), (1003, "."), (1004, rows[8][1])]
    labels += [(5000, 1), (7, None), (None, 1), (1, 0), (1000, 1), (1001, 0)]
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int"), rows


def test_raw_score_is_the_difference_of_compressed_sizes():
    good = [f"some plain words of text number {i} and more of them".encode() for i in range(2000)]
    bad = [f"BUY!! | NOW!! | {i} | CHEAP!! | OFFER!!".encode() for i in range(2000)]
    model = cq.QualityModel(cq.build_dictionary(bad), cq.build_dictionary(good), 0.5, 0.5)
    assert model.bad[1] and model.good[1]
    texts = ["plain words " * 90, "BUY!! | CHEAP!! | " * 90, "", "é" * 700]
    got = model.raw_scores(texts)
    for t, r in zip(texts, got):
        own = t.encode()
        sizes = []
        for content, _ in (model.bad, model.good):
            c = zstandard.ZstdCompressor(level=cq.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False,
                                         write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(own[i:i + cq.PIECE])) for i in range(0, len(own), cq.PIECE)))
        assert math.isnan(r) if not own else r == pytest.approx((sizes[0] - sizes[1]) / len(own))
    assert got[0] > 0 > got[1]


def test_scores(labelled):
    docs, labels, rows = labelled
    out = cq.quality_scores(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert sum(r.predicted != int(r.doc_id % 4 > 0) for r in out if r.doc_id is not None and r.doc_id < 900) <= 3
    score = {r.doc_id: r.score for r in out}
    assert score[1000] == score[1001] and score[None] == score[1] and score[1004] == score[8]
    assert sorted((r.score, r.predicted) for r in out if r.doc_id == 1002)[0][1] == 0


def test_held_out_labels_are_not_used(labelled, spark):
    docs, labels, _ = labelled
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    key = lambda df: sorted(str((r.doc_id, r.score)) for r in cq.quality_scores(docs, df).collect())
    assert key(labels) == key(flipped)


def test_few_or_no_labels(labelled, spark, make_docs):
    docs, labels, rows = labelled
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in cq.quality_scores(docs, none).collect()} == {0.0}
    one = {r.score for r in cq.quality_scores(docs, labels.filter("quality = 1 AND doc_id <> 1000")).collect()}
    assert one == {1.0}
    few = cq.quality_scores(docs, labels.filter("doc_id IN (0, 1, 2, 3, 4, 5, 8, 9, 12, 13, 16, 17)")).collect()
    assert len(few) == len(rows) and all(0 <= r.score <= 1 for r in few)
    assert cq.quality_scores(make_docs([]), labels).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels")
    r = cq.quality_scores(table(spark, d, "documents"), labels).join(labels, "doc_id")
    p = r.filter("held_out AND quality IS NOT NULL").select("score", "predicted", "quality").toPandas()
    ranks, pos = p.score.rank().to_numpy(), p.quality.to_numpy() == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / pos.sum() / (~pos).sum()
    assert auc >= 0.97 and (p.predicted[pos] == 1).mean() >= 0.95 and (p.predicted[~pos] == 0).mean() >= 0.9
    assert np.mean((p.score - p.quality) ** 2) < 0.03
