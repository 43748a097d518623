import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from concourse.llm import bpe_merge as bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def replay():
    return bpe.MergeReplay(bpe.read_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def reference(replay):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(replay.tokens)},
                             special_tokens={})


def encode(replay, texts):
    out = []
    for ids, end in replay.slices(pa.array(texts, pa.string())):
        out += np.split(ids, end[:-1])
    return [x.tolist() for x in out]


def test_equals_library(replay, reference):
    rnd, letters = random.Random(1), " \n\t\r'sabctdAB12.,!?  \x1c\x85éß中文🙂ñ́don'tre'll"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 1000, " " * 500, "\n" * 77, "<|endoftext|> x", "", "the  the", "a\n\nb", "a \nb", "a\n b", " a", "a "]
    texts += [chr(c) + "a " + chr(c) for c in range(1, 0x700)]
    ids = encode(replay, texts)
    assert ids == [reference.encode_ordinary(t) for t in texts]
    assert [replay.decode(np.array(i, np.uint32)) for i in ids] == [t.encode() for t in texts]


def test_slices_and_forgetting_change_nothing(replay, monkeypatch):
    texts = [f"some words {i} here.\nand there" for i in range(200)]
    want = encode(replay, texts)
    monkeypatch.setattr("concourse.llm.text_parts.SLICE", 100)
    small = bpe.MergeReplay(replay.tokens, PATTERN)
    small.parts.limit = 3
    assert encode(small, texts) == want


def test_ranks_out_of_merge_order():
    """A vocabulary in which a merge forms a token of lower rank than its parts'."""
    single = [bytes([b]) for b in range(256)]
    tokens = single + [b"abcd", b"bc", b"cd", b"ab", b"abc", b"bcd", b"aa", b"aaaa", b"aaa"]
    own = bpe.MergeReplay(tokens, PATTERN)
    ref = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    assert encode(own, words) == [ref.encode_ordinary(w) for w in words]


def test_query_columns(make_docs, reference):
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (3, ""), (None, "x " * 50_000), (5, "naïve 🙂")]
    got = sorted(map(tuple, bpe.encode_documents(make_docs(rows), PATH, PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    docs = make_docs(rows)
    ids = {r.doc_id: r.ids for r in bpe.with_ids(docs, PATH, PATTERN).select("doc_id", "ids").collect()}
    assert ids[5] == reference.encode_ordinary("naïve 🙂") and ids[2] == []
    assert bpe.encode_documents(make_docs([]), PATH, PATTERN).count() == 0
