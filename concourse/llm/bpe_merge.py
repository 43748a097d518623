"""Byte-level BPE encoding and decoding by merge replay over the words of a corpus block.

The texts of a task are split into words (matches of the pattern). The distinct words of
a block lie in one array of symbols, first one symbol per byte. An inverted index lists
for each token that can be formed the positions of the pairs that form it. Ranks are
taken in ascending order; each merges all its pairs, and only the neighbours of a merged
pair are looked up again and listed. Every word so goes through its own lowest-rank-first
merges. The ids of a document are its words' ids in a row; decoding joins the tokens'
bytes.

Blocks are a task's Arrow batches, bounded in rows and bytes, so encoding needs no shuffle and
its memory is bounded; words a worker has seen are kept up to ``KNOWN``.

Defined results: null texts count as empty; an empty text has no ids and decodes to
nothing. Any Unicode text decodes to its own UTF-8 bytes. Long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concourse.llm.common import fresh, whole_text
from concourse.llm.text_parts import PartEncoder

KNOWN = 600_000   # parts of texts a worker keeps the ids of; cleared when it has more
RESULT = ["n_tokens", "ids_sha256", "decoded_sha256"]
WORKERS: dict = {}  # a worker's encoders, by vocabulary; workers outlive tasks


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a rank file (base64 token and rank per line)."""
    with open(path, "rb") as f:
        rows = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [t for _, t in rows]


class MergeReplay:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.size = tokens, len(tokens)
        self.split = regex.compile(pattern).findall
        rank = {t: i for i, t in enumerate(tokens)}
        self.bytes = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        keys, ranks = [], []
        for t, r in rank.items():
            for i in range(1, len(t)):
                a, b = rank.get(t[:i]), rank.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ranks = np.array(ranks, np.int32)[order]
        self.token_lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.parts = PartEncoder(self.split, self.encode_parts, KNOWN)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair forms, -1 if none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, none empty, by replaying all merges over all words; ids are
        little-endian 32-bit integers."""
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        end = np.cumsum(lengths)
        after = np.arange(1, n + 1, dtype=np.int64)
        after[end - 1] = -1                      # -1: the word ends here
        before = np.arange(-1, n - 1, dtype=np.int64)
        before[end - lengths] = -1
        forms = np.full(n, -1, np.int32)         # rank of the pair that starts here
        start = np.flatnonzero(after >= 0)
        forms[start] = self.pair_rank(sym[start], sym[start + 1])
        live = np.ones(n, bool)
        odd: set[int] = set()                    # words whose merges are not in rank order

        listed = np.flatnonzero(forms >= 0)
        listed = listed[np.argsort(forms[listed], kind="stable")]
        of = forms[listed]
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        index = {int(of[c]): [x] for c, x in zip(cut, np.split(listed, cut[1:]))} if len(of) else {}
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            at = at[forms[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:                      # of overlapping pairs the left one merges
                chained = np.append(False, after[at[:-1]] == at[1:])
                if chained.any():
                    run = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[run % 2 == 0]
            gone = after[at]
            sym[at] = rank
            live[gone] = False
            forms[gone] = -1
            beyond = after[gone]
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            left = before[at]
            touched = np.concatenate([at, left[left >= 0]])
            nxt = after[touched]
            new = np.where(nxt >= 0, self.pair_rank(sym[touched], sym[np.maximum(nxt, 0)]), -1)
            forms[touched] = new
            can = new >= 0
            if not can.any():
                continue
            touched, new = touched[can], new[can]
            if new.min() < rank:
                odd.update(np.searchsorted(end, touched[new < rank], side="right").tolist())
            order = np.argsort(new, kind="stable")
            touched, new = touched[order], new[order]
            cut = np.flatnonzero(np.diff(new, prepend=-1))
            for r, x in zip(new[cut].tolist(), np.split(touched, cut[1:])):
                if r in index:
                    index[r].append(x)
                else:
                    index[r] = [x]
                    heapq.heappush(queue, r)
        ids = sym[live].astype("<u4").tobytes()
        stop = (4 * np.cumsum(np.add.reduceat(live.astype(np.int64), end - lengths))).tolist()
        out = [ids[a:b] for a, b in zip([0, *stop], stop)]
        for w in odd:
            out[w] = self.alone(words[w])
        return out

    def alone(self, word: bytes) -> bytes:
        """One word's ids, its lowest-ranked leftmost pair merged first."""
        ids = self.bytes[np.frombuffer(word, np.uint8)]
        while len(ids) > 1:
            ranks = self.pair_rank(ids[:-1], ids[1:])
            if ranks.max() < 0:
                break
            i = int(np.argmin(np.where(ranks < 0, self.size, ranks)))
            ids = np.concatenate([ids[:i], ranks[i:i + 1], ids[i + 2:]])
        return ids.astype("<u4").tobytes()

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, as little-endian 32-bit integers."""
        words = [[p] if _one_word(p) else self.split(p) for p in parts]
        distinct = list(dict.fromkeys(chain.from_iterable(words)))
        ids = dict(zip(distinct, self.replay([w.encode() for w in distinct]))) if distinct else {}
        return [ids[ws[0]] if len(ws) == 1 else b"".join(ids[w] for w in ws) for ws in words]

    def slices(self, texts: pa.Array):
        """(ids of all texts in a row, end of each text's ids) of slices of ``texts``."""
        return self.parts.slices(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, gathered from all tokens' bytes in one array."""
        lengths = self.token_lengths[ids]
        end = np.cumsum(lengths)
        if not len(end):
            return b""
        return self.token_bytes[np.arange(end[-1]) + np.repeat(self.token_starts[ids] - end + lengths, lengths)].tobytes()


def _one_word(part: str) -> bool:
    """Whether a part is surely a single match: ASCII letters, perhaps after a blank."""
    return part.isascii() and part.lstrip(" ").isalpha() and part[1:].isalpha()


def _worker(tokens_of, name: str, pattern: str) -> MergeReplay:
    """The worker's encoder; ``tokens_of`` is a broadcast of the vocabulary."""
    if (name, pattern) not in WORKERS:
        WORKERS[name, pattern] = MergeReplay(tokens_of.value, pattern)
    return WORKERS[name, pattern]


def with_ids(docs: DataFrame, ranks_path: str, pattern: str, name: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with a column of the ids of the whole text."""
    tokens = read_ranks(ranks_path)
    mark = hashlib.md5(b"\0".join(tokens)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), pa.array(ids.view(np.int32)))
                     for ids, end in _worker(shared, mark, pattern).slices(b)]
            yield pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(name, encoded(whole_text(text)))


def with_round_trip(docs: DataFrame, ranks_path: str, pattern: str, name: str = "bpe", text: str = "text") -> DataFrame:
    """``docs`` with a struct of n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (the bytes that the ids decode to)."""
    tokens = read_ranks(ranks_path)
    mark = hashlib.md5(b"\0".join(tokens)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            worker, n, own, decoded = _worker(shared, mark, pattern), [], [], []
            for ids, end in worker.slices(b):
                start = 0
                for stop in end.tolist():
                    n.append(stop - start)
                    own.append(hashlib.sha256(ids[start:stop].tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(worker.decode(ids[start:stop])).hexdigest())
                    start = stop
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(own, pa.string()),
                                              pa.array(decoded, pa.string())], RESULT)

    return docs.withColumn(name, digests(whole_text(text)))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    own = docs.select("doc_id", "text")
    return with_round_trip(own, ranks_path, pattern, fresh(own, "bpe")).select(
        "doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")
