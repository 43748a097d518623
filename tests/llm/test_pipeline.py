import hashlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import tiktoken

import __spark_entry__
from concourse.llm import bpe_merge, mixing, toxicity
from concourse.llm.common import staged, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = staged(cp.toxicity(spark, docs, SF), "t")
    assert kept.columns == docs.columns
    scores = toxicity.toxicity_scores(docs, table(spark, SF, "labels"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scores.collect() if not r.predicted}

    from test_order_minhash import brute_classes
    one = staged(cp.near_duplicates(spark, kept, SF), "n")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {min(c) for c in brute_classes(rows)}

    mix = staged(cp.mixing(spark, one, SF), "m")
    plan = {r.doc_id: r.copies if r["size"] else 1 for r in mixing.mix_plan(one).collect()}
    times = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert mix.columns == docs.columns and times == {k: v for k, v in plan.items() if v}

    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        t: i for i, t in enumerate(bpe_merge.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))})
    want = []
    for r in mix.collect():
        ids = np.array(ref.encode_ordinary(r.text), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    got = sorted(map(tuple, cp.encoding(spark, mix, SF).collect()))
    assert got == sorted(want)
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == got


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert 4 <= len(cp.STAGES) <= 5
