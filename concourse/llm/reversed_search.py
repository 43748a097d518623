"""Ranked lexical search turned round: the items' terms are the index, the documents the stream.

Items are taken in blocks of bounded size. A block's inverted index (term -> items that hold it) is
broadcast; every document's term counts run through it once, and each task keeps a heap of the best
documents per item. Heaps of all tasks are merged by a window with a limit, which Spark applies
before and after its shuffle, so a task sends ``k`` rows per item at most.

A slice of documents is scored in two steps. With the largest share of each term in the slice, an
item's terms that together stay under the item's worst kept score can't lift a document into its heap;
only the other terms are looked up for all documents, and documents they hit get their whole score. So
frequent terms cost nothing once the heaps are full, and the result stays exact.

Weights and shares are 64-bit integers (see ``weights`` and ``_Scorer``). Document counts, lengths and
frequencies come from a pass over all documents, of which each task sends sums.

Defined results: null or empty texts hold no term; such documents don't count and such items have no
rows. Items of equal text are searched once and each gets the rows; repeated item_ids are separate
items. Each document row counts, repeated or not; equal scores go by ascending doc_id, null ids last.
Empty tables give an empty result. Extra columns are ignored. ``MOST_BYTES`` and ``MOST_ITEMS`` bound a
block, but one item is never split: its own text is the bound then. More blocks mean more passes over
the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concourse.llm.common import staged

MOST_BYTES = 8 << 20    # of item texts in a block, on average by hash
MOST_ITEMS = 20_000
TOP = 10
SLICE = 1024            # documents that are scored at once
CELLS = 1 << 21         # looked-up postings and (document, item) cells that are held at once
UNIT, STEP, FLAT = 10 ** 9, 1000, 8     # share of a term: UNIT * tf div (STEP * tf + FLAT * m)
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes outside of TERMS become blanks, A-Z lower case; bytes from 0x80 belong to other characters.
_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_BYTES).split() if text else []


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


@dataclass
class ItemIndex:
    """Postings in order of (item, weight x repeats): term, repeats; ``of_term`` holds their places by term."""
    keys: list[bytes]           # of the items
    vocabulary: dict[bytes, int]
    item: np.ndarray
    term: np.ndarray
    repeats: np.ndarray
    weight: np.ndarray          # of the terms

    @classmethod
    def of(cls, items: list[tuple[bytes, list[bytes]]]) -> "ItemIndex":
        vocabulary: dict[bytes, int] = {}
        item, term, repeats = [], [], []
        for i, (_, words) in enumerate(items):
            for w, n in Counter(words).items():
                item.append(i)
                term.append(vocabulary.setdefault(w, len(vocabulary)))
                repeats.append(n)
        return cls([k for k, _ in items], vocabulary, *(np.array(x, np.int64) for x in (item, term, repeats)),
                   np.zeros(len(vocabulary), np.int64))

    def weighed(self, n_docs: int, df: np.ndarray) -> "ItemIndex":
        weight = weights(n_docs, df)
        order = np.lexsort((self.repeats * weight[self.term], self.item))
        return ItemIndex(self.keys, self.vocabulary, self.item[order], self.term[order], self.repeats[order], weight)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class _Scorer:
    """Heaps of the best ``k`` documents of each item of a block."""

    def __init__(self, index: ItemIndex, n_docs: int, n_terms: int, k: int):
        self.index, self.n_docs, self.n_terms, self.k = index, n_docs, n_terms, k
        self.by_term = np.argsort(index.term, kind="stable")
        self.term_start = np.searchsorted(index.term[self.by_term], np.arange(len(index.weight) + 1))
        self.item_start = np.searchsorted(index.item, np.arange(len(index.keys) + 1))
        self.worst = np.zeros(len(index.keys), np.int64)    # of a full heap, else 0
        self.heap = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

    def add(self, ids: np.ndarray, no_id: np.ndarray, found: list[tuple[int, dict[int, int]]]) -> None:
        """Documents with their length in terms and their counts of known terms."""
        row = np.repeat(np.arange(len(found)), [len(c) for _, c in found])
        term = np.fromiter((t for _, c in found for t in c), np.int64, len(row))
        tf = np.fromiter((n for _, c in found for n in c.values()), np.int64, len(row))
        m = np.array([25 + 75 * n * self.n_docs // self.n_terms for n, _ in found], np.int64)
        share = UNIT * tf // (STEP * tf + FLAT * m[row])
        order = np.lexsort((term, row))
        row, term, gain = row[order], term[order], (share * self.index.weight[term])[order]
        most = np.zeros(len(self.index.weight), np.int64)
        np.maximum.at(most, term, gain)
        x = self.index
        bound = x.repeats * most[x.term]
        total = np.cumsum(bound)
        before = np.append(0, total)[self.item_start[x.item]]
        low = total - before < self.worst[x.item]       # these, and those before them in the item, can't lift a document
        spare = np.zeros(len(x.keys), np.int64)
        np.maximum.at(spare, x.item[low], (total - before)[low])
        cost = np.append(0, np.cumsum((self.term_start[1:] - self.term_start[:-1])[term]))
        rows_at = np.searchsorted(row, np.arange(len(found) + 1))
        at = 0
        while at < len(found):
            end = max(at + 1, min(int(np.searchsorted(cost[rows_at], cost[rows_at[at]] + CELLS, side="right")) - 1,
                                  at + max(1, CELLS // max(1, len(x.keys)))))
            part = slice(rows_at[at], rows_at[end])
            self._part(at, end - at, row[part], term[part], gain[part], low, spare, ids, no_id)
            at = end

    def _part(self, at, n, row, term, gain, low, spare, ids, no_id) -> None:
        x, items = self.index, len(self.index.keys)
        size = (self.term_start[1:] - self.term_start[:-1])[term]
        entry = self.by_term[_runs(self.term_start[term], size)]
        high = ~low[entry]
        entry = entry[high]
        scores = np.zeros(n * items, np.int64)
        np.add.at(scores, (np.repeat(row - at, size)[high]) * items + x.item[entry],
                  np.repeat(gain, size)[high] * x.repeats[entry])
        cell = np.flatnonzero(scores)
        item = cell % items
        open_ = scores[cell] + spare[item] >= self.worst[item]
        cell, item = cell[open_], item[open_]
        score = scores[cell]
        lows = np.append(0, np.cumsum(low))
        size = lows[self.item_start[1:]] - lows[self.item_start[:-1]]     # low entries come first in an item
        key = row * len(x.weight) + term
        for a in range(0, len(cell), 1 << 16):      # whole scores of the documents that are left
            own = slice(a, a + (1 << 16))
            each = size[item[own]]
            entry = _runs(self.item_start[item[own]], each)
            want = np.repeat(cell[own] // items + at, each) * len(x.weight) + x.term[entry]
            place = np.minimum(np.searchsorted(key, want), len(key) - 1)
            more = np.where(key[place] == want, gain[place], 0) * x.repeats[entry]
            sums = np.append(0, np.cumsum(more))
            ends = np.cumsum(each)
            score[own] += sums[ends] - sums[ends - each]
        fits = score >= self.worst[item]
        doc = cell[fits] // items + at
        self._merge(item[fits], score[fits], ids[doc], no_id[doc])

    def _merge(self, *rows: np.ndarray) -> None:
        item, score, doc, none = (np.concatenate(x) for x in zip(self.heap, rows))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        first = np.searchsorted(item, item, side="left")
        stay = np.arange(len(item)) - first < self.k
        order, item = order[stay], item[stay]
        self.heap = [item, score[order], doc[order], none[order]]
        full = np.flatnonzero((np.arange(len(item)) - np.searchsorted(item, item, side="left")) == self.k - 1)
        self.worst[item[full]] = self.heap[1][full]


def _slices(batch: pa.RecordBatch):
    """(ids, null ids, texts) of up to SLICE documents."""
    for at in range(0, batch.num_rows, SLICE):
        b = batch.slice(at, SLICE)
        own = b.column(0)
        yield own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False), b.column(1)


def corpus_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents that hold a term, all their terms with repeats, and the documents of each term of the
    vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def sums(batches):
        known = shared.value
        n, total, df = 0, 0, np.zeros(len(known), np.int64)
        for b in batches:
            for t in b.column(1):
                words = terms(t.as_py())
                n += bool(words)
                total += len(words)
                df[[known[w] for w in known.keys() & set(words)]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, total]))], ["term", "df"])

    rows = docs.mapInArrow(sums, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")) \
        .toArrow().to_pandas().set_index("term")["df"]      # a row per term of the block and two more
    shared.unpersist()
    df = np.zeros(len(vocabulary), np.int64)
    own = rows[rows.index >= 0]
    df[own.index.to_numpy()] = own.to_numpy()
    return int(rows.get(-1, 0)), int(rows.get(-2, 0)), df


def _block_rows(docs: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    """(key, doc_id, score): the best ``k`` documents of each item of a block, from each task."""
    own = sorted((bytes(r.key), terms(r.text)) for r in block.collect())     # a block: MOST_BYTES, MOST_ITEMS
    index = ItemIndex.of([(key, words) for key, words in own if words])
    if not index.keys:
        return None
    n_docs, n_terms, df = corpus_counts(docs, index.vocabulary)
    if not n_docs:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(index.weighed(n_docs, df))

    def best(batches):
        x = shared.value
        known, scorer = x.vocabulary, _Scorer(x, n_docs, n_terms, k)
        for b in batches:
            for ids, no_id, texts in _slices(b):
                found = []
                for t in texts:
                    words = terms(t.as_py())
                    count = Counter(words)
                    found.append((len(words), {known[w]: count[w] for w in known.keys() & count.keys()}))
                scorer.add(ids, no_id, found)
        item, score, doc, none = scorer.heap
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.keys[i] for i in item], pa.binary()), pa.array(doc, pa.int64(), mask=none), pa.array(score, pa.int64())],
            ["key", "doc_id", "score"])

    return docs.mapInArrow(best, "key binary, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.select("item_id", F.md5("text").cast("binary").alias("key"), "text").filter(F.col("text").isNotNull())
    texts = staged(asked.groupBy("key").agg(F.min("text").alias("text")), "items")
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-size // MOST_BYTES), -(-n // MOST_ITEMS))
    heaps = texts.sparkSession.createDataFrame([], "key binary, doc_id long, score long")
    for b in range(blocks):
        found = _block_rows(own, texts.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b), k)
        if found is not None:
            heaps = heaps.union(staged(found, "heaps"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = heaps.withColumn("rank", place).filter(F.col("rank") <= k)
    return asked.select("item_id", "key").join(best, "key").select("item_id", "rank", "doc_id", "score")


def ranked_sql(k: int = TOP) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{TERMS}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
q AS (SELECT i, term, count(*) AS repeats FROM (
        SELECT i, unnest(words) AS term FROM (
          SELECT row_number() OVER () AS i, {words} AS words FROM benchmark WHERE text IS NOT NULL)) GROUP BY i, term),
b AS (SELECT row_number() OVER () AS i, item_id FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 25 + (75 * len(words) * n_docs) // n_terms AS m FROM d, s WHERE len(words) > 0),
scores AS (
  SELECT i, r, any_value(doc_id) AS doc_id,
         sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY i, r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
  FROM scores JOIN b USING (i) WHERE score > 0)
WHERE rank <= {k}
"""
